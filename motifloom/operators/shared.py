"""Operators across documents: duplicates, weights, shared dictionaries, the pattern cache."""

from __future__ import annotations

import logging
import math
from collections import Counter

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motifloom.config import Config
from motifloom.functions import arithmetic as ar
from motifloom.functions.tokens import token_count
from motifloom.sources.storage import settled, unused

from .corpus import candidates, per_document


def without_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each text: that of the smallest key, a null key coming last.

    Null and empty texts are alike; of equal keys one row stays, whichever its
    other columns put first.  Texts meet by hash, and each task passes on only
    its first row of each, so a text that many rows share isn't shuffled for
    all of them.
    """
    own, place = unused(docs, "hash"), unused(docs, "place")
    by = Window.partitionBy(own).orderBy(F.col(key).asc_nulls_last(), F.xxhash64(*docs.columns))
    ranked = docs.withColumn(own, F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).withColumn(place, F.row_number().over(by))
    return ranked.filter(F.col(place) == 1).drop(own, place)


def duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(hash, doc_id, copies) of each text: the key that stays for it, null only if it has no other, and how many rows have it; partially aggregated."""
    own = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    return docs.groupBy(own.alias("hash")).agg(F.min(key).alias("doc_id"), F.count("*").alias("copies"))


def preprocessed(docs: DataFrame, least: int = 1, most: int = 0, text: str = "text") -> DataFrame:
    """Distinct documents of at least ``least`` and, unless it is 0, at most ``most`` tokens, with ``n_tokens``."""
    rows = without_duplicates(docs, text).withColumn("n_tokens", token_count(F.col(text)))
    return rows.filter((F.col("n_tokens") >= least) & (F.lit(most == 0) | (F.col("n_tokens") <= most)))


def weights(vectors: DataFrame, clusters: int = 32, seed: int = 7, key: str = "vec_id", column: str = "embedding", normalise: bool = True) -> DataFrame:
    """(key, cluster, weight): one over the size of the k-means cluster that a document's vector falls in."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from motifloom.functions.vectors import normalised

    values = normalised(F.col(column)) if normalise else F.col(column).cast("array<double>")
    rows = vectors.select(key, array_to_vector(values).alias("features"))
    n = rows.count()
    if not n:
        return rows.select(key, F.lit(0).alias("cluster"), F.lit(1.0).alias("weight"))
    model = KMeans(k=max(2, min(clusters, n)), seed=seed, maxIter=20).fit(rows)
    placed = model.transform(rows).select(key, F.col("prediction").alias("cluster"))
    size = placed.groupBy("cluster").agg(F.count("*").alias("size"))
    return placed.join(F.broadcast(size), "cluster").select(key, "cluster", (1 / F.col("size")).alias("weight"))  # a row a cluster


def static_dictionary(docs: DataFrame, config: Config = Config(), entries: int = 256, weight: DataFrame | None = None, least_documents: int = 1) -> DataFrame:
    """(rank, meta, pattern, length, total, documents, score): the patterns that save most over the corpus.

    What pays in some document counts there without overlap; the score is what
    the total saves times the weight of the documents (1 each, unless
    ``weight`` (doc_id, weight) says otherwise).  One partially aggregated
    shuffle by pattern.
    """
    found = candidates(docs, config).select("doc_id", "pattern", "length", "n")
    if weight is not None:
        found = found.join(weight.select("doc_id", "weight"), "doc_id", "left").fillna(1.0, ["weight"])
    else:
        found = found.withColumn("weight", F.lit(1.0))
    total = found.groupBy("pattern", "length").agg(F.sum("n").alias("total"), F.count("*").alias("documents"), F.sum("weight").alias("weight"))
    kept = total.filter(ar.pays_column(F.col("length"), F.col("total"), config.extra) & (F.col("documents") >= least_documents))
    scored = kept.withColumn("score", F.round(ar.raw_savings_column(F.col("length"), F.col("total"), config.extra) * F.col("weight"), 6))
    best = scored.orderBy(F.desc("score"), F.desc("length"), "pattern").limit(entries)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("length"), "pattern")))  # at most ``entries`` rows
    return ranked.select("rank", F.concat(F.lit("<SD_"), F.col("rank") - 1, F.lit(">")).alias("meta"), "pattern", "length", "total", "documents", "score")


log = logging.getLogger(__name__)
_STATE = ["pattern", "length", "frequency", "occurrences", "savings", "first_seen", "last_seen"]


def learned(cache: DataFrame | None, found: DataFrame, at: int, config: Config = Config(), most: int | None = None) -> DataFrame:
    """The cache (pattern, length, frequency, occurrences, savings, first_seen, last_seen) after the patterns (pattern, length, n) of one operation ``at``.

    All patterns stay, unless ``most`` is given: beyond so many the best four
    fifths of that do.
    """
    kept = found.filter(F.col("length").between(config.min_length, config.max_length))
    new = kept.groupBy("pattern", "length").agg(F.count("*").alias("frequency"), F.sum("n").alias("occurrences"), F.sum(ar.savings_column(F.col("length"), F.col("n"), config.extra)).alias("savings"))
    rows = new.withColumns({"first_seen": F.lit(at).cast("bigint"), "last_seen": F.lit(at).cast("bigint")}).select(*_STATE)
    if cache is not None:
        rows = cache.select(*_STATE).unionByName(rows)
        rows = rows.groupBy("pattern", "length").agg(*[F.sum(c).alias(c) for c in ("frequency", "occurrences", "savings")], F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")).select(*_STATE)
    if most is None or rows.count() <= most:
        return rows
    return rows.orderBy(F.desc(cache_score(F.lit(at))), "pattern").limit(most * 4 // 5)


CACHE_VERSION = 1


def save_cache(cache: DataFrame, path: str) -> None:
    """Writes the cache as JSON lines, each with the version of the format; what was at ``path`` goes."""
    settled(cache.select(*_STATE)).withColumn("version", F.lit(CACHE_VERSION)).write.mode("overwrite").json(path)


def load_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """A saved cache; None, with a warning, where there is none, its version is another, or a line is broken or lacks something."""
    kinds = "pattern string, length bigint, frequency bigint, occurrences bigint, savings bigint, first_seen bigint, last_seen bigint, version int, _broken string"
    try:
        rows = settled(spark.read.schema(kinds).option("columnNameOfCorruptRecord", "_broken").json(path))
    except AnalysisException:
        log.warning("no cache at %s", path)
        return None
    lacks = F.lit(False)
    for c in [*_STATE, "version"]:
        lacks = lacks | F.col(c).isNull()
    found = rows.agg(F.count_if(F.col("_broken").isNotNull() | lacks).alias("broken"), F.count_if(F.col("version") != CACHE_VERSION).alias("other")).first()
    if found["broken"] or found["other"]:
        log.warning("the cache at %s can't be used: %s broken lines, %s of another version", path, found["broken"], found["other"])
        return None
    return rows.select(*_STATE)


def cache_score(now: Column, half_life: float = 100.0) -> Column:
    """Often seen, lately seen, saving much, long: the higher the better."""
    mean = F.col("savings") / F.greatest(F.col("frequency"), F.lit(1))
    age = now - F.col("last_seen")
    return F.log1p(F.col("frequency").cast("double")) * F.pow(F.lit(0.5), age / half_life) * F.when(mean > 0, mean).otherwise(1.0) * F.log1p(F.col("length").cast("double"))


def warm_start(docs: DataFrame, cache: DataFrame, now: int, top: int = 50, least: int = 2) -> DataFrame:
    """(doc_id, pattern, length, hits, priority): cached patterns that occur at least twice in a document.

    Of the cache the best ``2 * top`` are looked for, and the best ``top`` of
    those that a document has are kept; documents are not shuffled.
    """
    best = cache.filter(F.col("frequency") >= least).withColumn("score", cache_score(F.lit(now))).orderBy(F.desc("score"), "pattern").limit(2 * top)
    listed = [(r["pattern"], tuple(r["pattern"].split(" ")), r["score"]) for r in best.select("pattern", "score").collect()]  # 2 * top at most
    ranked = {p: (i, text, score) for i, (text, p, score) in enumerate(sorted(listed, key=lambda x: (-x[2], x[0])))}
    lengths = sorted({len(p) for p in ranked})

    def work(doc_id: object, words: list[str]):
        hits: Counter[tuple[str, ...]] = Counter()
        for n in lengths:
            hits.update(g for g in zip(*(words[k:] for k in range(n))) if g in ranked)
        found = sorted((ranked[g], len(g), c) for g, c in hits.items() if c > 1)
        for (_, text, score), n, c in found[:top]:
            yield doc_id, text, n, c, int(score * 100)

    return per_document(docs, "doc_id bigint, pattern string, length bigint, hits bigint, priority bigint", work)


def cache_statistics(cache: DataFrame) -> DataFrame:
    """(patterns, occurrences, savings, mean_length)."""
    return cache.agg(F.count("*").alias("patterns"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"), F.coalesce(F.sum("savings"), F.lit(0)).alias("savings"), F.avg("length").alias("mean_length"))


def known_patterns(found: DataFrame, cache: DataFrame) -> DataFrame:
    """Patterns that the cache has; Spark filters by a sketch of the cache's keys before it shuffles."""
    return found.join(cache.select("pattern"), "pattern", "left_semi")


def bloom_size(n: int, error: float = 0.01) -> tuple[int, int]:
    """Bits and hash functions of a Bloom filter for so many keys."""
    bits = max(1, math.ceil(-n * math.log(error) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(1, n) * math.log(2)))


def bloom(keys: DataFrame, column: str, n: int, error: float = 0.01) -> DataFrame:
    """(bits): a Bloom filter as its set positions, merged over all partitions."""
    size, k = bloom_size(n, error)
    places = F.array(*[F.pmod(F.xxhash64(F.col(column), F.lit(i)), F.lit(size)) for i in range(k)])
    return keys.select(F.explode(places).alias("bit")).distinct()


def maybe_in(rows: DataFrame, column: str, bits: DataFrame, n: int, error: float = 0.01) -> DataFrame:
    """``rows`` whose key may be among those of the filter: never too few, at most ``error`` too many."""
    size, k = bloom_size(n, error)
    places = F.array(*[F.pmod(F.xxhash64(F.col(column), F.lit(i)), F.lit(size)) for i in range(k)])
    key = rows.select(column).distinct().select(column, F.explode(F.array_distinct(places)).alias("bit"))
    set_ = key.join(bits, "bit").groupBy(column).agg(F.count("*").alias("set"))
    whole = rows.select(column).distinct().select(column, F.size(F.array_distinct(places)).alias("asked"))
    return rows.join(whole.join(set_, column).filter("asked = set").select(column), column, "left_semi")


def mean_cosine(vectors: DataFrame, group: str, column: str = "embedding") -> DataFrame:
    """(group, n, similarity): the mean cosine over all pairs of each group's vectors; 1 where there is but one.

    The squared length of the sum of unit vectors holds the cosines of all
    pairs, so no pair is ever formed: the sums are taken by group and
    dimension, partially aggregated.
    """
    from motifloom.functions.vectors import normalised

    sized = vectors.groupBy(group).agg(F.count("*").alias("n"))
    flat = vectors.select(group, F.posexplode(normalised(F.col(column))).alias("d", "x"))
    sums = flat.groupBy(group, "d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("own"))
    total = sums.groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("all"), F.sum("own").alias("own"))
    n = F.col("n").cast("double")
    return sized.join(total, group, "left").select(group, "n", F.when(F.col("n") > 1, (F.coalesce("all", F.lit(0.0)) - F.coalesce("own", F.lit(0.0))) / (n * (n - 1))).otherwise(1.0).alias("similarity"))


def training_examples(turns: DataFrame, share: float = 0.5) -> DataFrame:
    """(conv_id, turn, n_input, n_target, compressed): the examples of each answer with what came before it.

    Loss falls on the target alone; which prompts are to be compressed follows
    from the hash of the conversation and turn.
    """
    by = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumn("n_tokens", token_count(F.col("text"))).withColumn("prompt", F.coalesce(F.sum("n_tokens").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    lot = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    return rows.filter((F.col("role") == "assistant") & (F.col("prompt") > 0)).select("conv_id", "turn", (F.col("prompt") + F.col("n_tokens")).alias("n_input"), F.col("n_tokens").alias("n_target"), (lot < share).alias("compressed"))


def with_loss_mask(examples: DataFrame) -> DataFrame:
    """Adds ``input`` (prompt and target) and ``loss_mask`` to rows with arrays ``prompt`` and ``target``."""
    return examples.withColumn("input", F.concat("prompt", "target")).withColumn("loss_mask", F.concat(F.array_repeat(F.lit(0), F.size("prompt")), F.array_repeat(F.lit(1), F.size("target"))))


def curriculum(base: Config = Config()) -> list[tuple[str, Config, float]]:
    """(name, settings, share compressed) of three stages, each harder than the one before."""
    return [
        ("baseline", base.but(hierarchical=False, max_length=max(base.min_length, 4)), 0.4),
        ("intermediate", base.but(hierarchical=True, passes=2, max_length=max(base.min_length, 6)), 0.5),
        ("advanced", base.but(hierarchical=True, passes=3), 0.6),
    ]


def vocabulary(spark, config: Config = Config()) -> DataFrame:
    """(ord, token, kind): the tokens that a model's vocabulary needs to read coded sequences."""
    metas = spark.range(config.pool).select(F.col("id").alias("ord"), F.concat(F.lit(config.meta[0]), F.col("id").cast("string"), F.lit(config.meta[1])).alias("token"), F.lit("meta").alias("kind"))
    special = [*config.dictionary]
    if config.length_tokens:
        special.append("0".join(config.length_mark))
    if config.fuzzy:
        special += [*config.patch, "0".join(config.index_mark)]
    if config.static_id or config.static_auto:
        special.append("example".join(config.static_mark))
    return metas.unionByName(spark.createDataFrame([(config.pool + i, t, "special") for i, t in enumerate(special)], "ord bigint, token string, kind string"))
