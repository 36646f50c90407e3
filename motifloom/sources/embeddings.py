"""Vectors of texts: providers, and a table that remembers what they gave."""

from __future__ import annotations

import hashlib
import json
import unicodedata
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EVICTED = 0.1  #: share of the table dropped once it is too large


class Provider(Protocol):
    """Gives a vector for each text."""

    name: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Hashed:
    """Words hashed into signed places: no model, no network, always the same."""

    def __init__(self, dimension: int = 64) -> None:
        self.dimension, self.name = dimension, f"hashed-{dimension}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()[:8], "little")
                row[h % self.dimension] += 1 if h >> 63 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=out, where=size > 0).tolist()


class Http:
    """A service that takes {"model", "input"} and returns vectors, in the field that ``pick`` finds."""

    def __init__(self, url: str, model: str, key: str | None = None, pick: Callable[[dict], list[list[float]]] | None = None) -> None:
        self.url, self.name, self.key = url, model, key
        self.pick = pick or (lambda reply: [d["embedding"] for d in reply["data"]])

    def embed(self, texts: list[str]) -> list[list[float]]:
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(self.url, json.dumps({"model": self.name, "input": texts}).encode(), head)
        with urllib.request.urlopen(request, timeout=60) as reply:
            return self.pick(json.load(reply))


class Sentences:
    """A sentence-transformers model, where that library is installed."""

    def __init__(self, model: str) -> None:
        from sentence_transformers import SentenceTransformer

        self.name, self.own = model, SentenceTransformer(model)

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self.own.encode(texts).tolist()


#: where each service takes its requests, and its usual model, if it has one
SERVICES = {
    "ollama": ("http://localhost:11434/api/embed", "nomic-embed-text", lambda r: r["embeddings"]),
    "openai": ("https://api.openai.com/v1/embeddings", None, None),
    "voyage": ("https://api.voyageai.com/v1/embeddings", "voyage-3", None),
    "cohere": ("https://api.cohere.com/compatibility/v1/embeddings", "embed-english-v3.0", None),
}
_ALIASES = {"huggingface": "sentences", "hf": "sentences", "sentence-transformers": "sentences", "hash": "hashed", "test": "hashed"}


def provider(kind: str, model: str | None = None, key: str | None = None, **more: int) -> Provider:
    """The provider of this kind; ValueError for one that isn't known."""
    kind = _ALIASES.get(kind.lower(), kind.lower())
    if kind == "hashed":
        return Hashed(**more)
    if kind == "sentences":
        return Sentences(model or "all-MiniLM-L6-v2")
    if kind not in SERVICES:
        raise ValueError(f"Unknown embedding provider: {kind}")
    url, usual, pick = SERVICES[kind]
    if not (model or usual):
        raise ValueError(f"{kind} needs the name of a model")
    return Http(url, model or usual, key, pick)


def provider_or_none(kind: str | None, **settings: str) -> Provider | None:
    """Likewise; None where there is no such provider here."""
    try:
        return provider(kind, **settings) if kind else None
    except (ValueError, ImportError):
        return None


def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t.strip()))


def keyed(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with ``cache_key``: the hash of model and composed text."""
    return docs.withColumn("cache_key", F.sha2(F.concat(F.lit(f"{model}:"), F.pandas_udf(_composed, "string")(F.coalesce(F.col(text), F.lit("")))), 256))


def embedded(docs: DataFrame, own: Provider, text: str = "text", batch: int = 256) -> DataFrame:
    """``docs`` with ``embedding``, asked for in batches."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in own.embed(texts[i : i + batch])])

    return docs.withColumn("embedding", embed(text))


def with_cache(docs: DataFrame, cache: DataFrame, own: Provider, text: str = "text") -> DataFrame:
    """``docs`` with ``embedding`` and ``hit``: from the table (cache_key, embedding) where it has it, else from the provider."""
    keys = keyed(docs, own.name, text)
    held = keys.join(cache.select("cache_key", "embedding").dropDuplicates(["cache_key"]), "cache_key", "left")
    hits = held.filter("embedding is not null").withColumn("hit", F.lit(True))
    misses = embedded(held.filter("embedding is null").drop("embedding"), own, text).withColumn("hit", F.lit(False))
    return hits.unionByName(misses)


def updated(cache: DataFrame, found: DataFrame, now: int, limit: int) -> DataFrame:
    """The table (cache_key, embedding, created_at, access_count, last_accessed) after ``found`` (cache_key, embedding, hit) was used.

    Beyond ``limit`` rows the tenth used longest ago goes.
    """
    used = found.groupBy("cache_key").agg(F.first("embedding").alias("embedding"), F.count("*").alias("uses"))
    both = cache.alias("c").join(used.alias("u"), "cache_key", "full")
    rows = both.select(
        "cache_key",
        F.coalesce("c.embedding", "u.embedding").alias("embedding"),
        F.coalesce("created_at", F.lit(now)).alias("created_at"),
        (F.coalesce("access_count", F.lit(0)) + F.coalesce("uses", F.lit(0))).alias("access_count"),
        F.when(F.col("uses").isNotNull(), F.lit(now)).otherwise(F.col("last_accessed")).alias("last_accessed"),
    )
    n = rows.count()
    if n <= limit:
        return rows
    # the cut is one value found by the range-partitioned sort, not one window over the table
    oldest = rows.select("last_accessed", "cache_key").orderBy("last_accessed", "cache_key").limit(max(1, int(n * EVICTED)))
    return rows.join(oldest.select("cache_key"), "cache_key", "left_anti")


def hit_rate(found: DataFrame) -> DataFrame:
    """(hits, misses, hit_rate) of ``with_cache``."""
    hits, n = F.count_if("hit"), F.count("*")
    return found.agg(hits.alias("hits"), (n - hits).alias("misses"), F.when(n > 0, hits / n).otherwise(0.0).alias("hit_rate"))


def ranked_by_access(cache: DataFrame) -> DataFrame:
    """The table with the place of each row by age of its last use, in each of 256 ranges of the key."""
    return cache.withColumn("age_rank", F.row_number().over(Window.partitionBy(F.substring("cache_key", 1, 2)).orderBy("last_accessed", "cache_key")))
