"""From a corpus to a static dictionary: load, preprocess, embed, weigh, build."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.config import Config
from motifloom.operators import shared
from motifloom.sources.embeddings import Provider, embedded, with_cache


def analysed(docs: DataFrame, own: Provider, config: Config = Config(), entries: int = 256, clusters: int = 32, cache: DataFrame | None = None, least: int = 1, most: int = 0) -> DataFrame:
    """The static dictionary of a corpus, each document weighted by how common its kind is."""
    kept = shared.preprocessed(docs, least, most)
    vectors = with_cache(kept, cache, own) if cache is not None else embedded(kept, own)
    weight = shared.weights(vectors, clusters, key="doc_id")
    return shared.static_dictionary(kept, config, entries, weight)


def as_static(dictionary: DataFrame) -> dict[str, tuple[str, ...]]:
    """The entries of a built dictionary (as few as were asked for), to register or save."""
    return {r["meta"]: tuple(r["pattern"].split(" ")) for r in dictionary.orderBy("rank").select("meta", "pattern").collect()}


def ratio_by_group(coded: DataFrame, docs: DataFrame, *groups: str) -> DataFrame:
    """Ratio by every combination of document columns, with subtotals."""
    rows = coded.join(docs.select("doc_id", *groups), "doc_id")
    return rows.cube(*groups).agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_coded").alias("n_coded"), F.round(F.sum("n_coded") / F.sum("n_tokens"), 6).alias("ratio"))
