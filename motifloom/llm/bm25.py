"""Exact top-k search: BM25 over sharded inverted indexes with block-max WAND.

Every task turns its documents into an inverted index of all their words, with
the documents' lengths; the shards are a table, written once and searched as
often as one likes.  Document frequencies of the words asked for, the number of
documents and their mean length are summed over all shards, so each shard
scores with global statistics and the merged result is exact.

Within a shard, postings lie in blocks of ``BLOCK`` consecutive documents, each
with the largest score any of its postings can add.  A query takes the blocks
of documents in the order of their upper bounds (the sum over its words of the
block maxima); it ends once no bound reaches the k-th best score so far.  In a
block that it enters, the documents are pivoted as in WAND: one whose own bound,
the sum of the maxima of just those lists that contain it, cannot reach the
k-th best is passed over; only the others are scored.

Score: sum over the distinct words of the query of
``ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len / avg_len))``,
rounded to 6 digits; equal scores are ranked by ``doc_id``.

Queries are searched in parts of at most ``MAX_TERMS`` words, each over the
same shards, so what is broadcast never grows with their number.

Defined results: rows with a null ``doc_id`` cannot be named and are left out,
from the statistics too; null and empty texts are documents of length 0 that no
query finds, and as queries find nothing; only documents that share a word with
a query are ranked; equal rows of (item_id, text) are one query, and queries
that share an ``item_id`` are ranked apart; repeated document rows are
documents of their own; empty tables give an empty result; other columns are
not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, kernels

K1, B = 1.2, 0.75
TOP_K = 10
BLOCK = 128
MAX_TERMS = 2_000_000
SHARD_POSTINGS = 3_000_000
SHARD_DOCS = 50_000
_ROUND = 1e-6
_SHARD = pa.schema([("n_docs", pa.int64()), ("n_words", pa.int64()), ("n_postings", pa.int64()), ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("terms", pa.binary()), ("counts", pa.binary()), ("docs", pa.binary()), ("tf", pa.binary())])
_SHARD_SQL = "n_docs bigint, n_words bigint, n_postings bigint, doc_ids binary, lengths binary, terms binary, counts binary, docs binary, tf binary"


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def index(docs: DataFrame) -> DataFrame:
    """Shards of the inverted index over all words of docs (doc_id, text): a table to write once and search often."""

    def shard(ids: list, lengths: list, terms: list, rows: list, tfs: list) -> pa.RecordBatch:
        term, doc, tf, length = np.concatenate(terms), np.concatenate(rows), np.concatenate(tfs), np.concatenate(lengths)
        order = np.argsort(term, kind="stable")  # documents stay in order within a word
        term, count = np.unique(term[order], return_counts=True)
        steps = np.diff(doc[order].astype(np.int64), prepend=0).astype(np.int32)
        return common.record(_SHARD, [len(length)], [int(length.sum())], [len(doc)], *[pa.array([x], pa.binary()) for x in (np.concatenate(ids).tobytes(), length.tobytes(), term.tobytes(), count.astype(np.uint32).tobytes(), _packed(steps), _packed(tf[order].astype(np.uint32)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [], [])
        n = postings = 0
        for batch in batches:
            for at, texts in kernels.slices(kernels.as_strings(batch.column("text"))):
                w = kernels.words(texts)
                own, which = np.unique(w.hash, return_inverse=True)
                key, tf = np.unique(which.astype(np.uint64) << np.uint64(32) | w.row.astype(np.uint64), return_counts=True)
                row = (key & np.uint64(2**32 - 1)).astype(np.uint32) + np.uint32(n)
                for x, more in zip(held, (batch.column("doc_id").slice(at, len(texts)).to_numpy(), np.diff(w.bounds).astype(np.uint32), own[(key >> np.uint64(32)).astype(np.int64)], row, tf)):
                    x.append(more)
                n, postings = n + len(texts), postings + len(key)
                if postings >= SHARD_POSTINGS or n >= SHARD_DOCS:
                    yield shard(*held)
                    held, n, postings = ([], [], [], [], []), 0, 0
        if n:
            yield shard(*held)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").filter("doc_id is not null").mapInArrow(run, _SHARD_SQL)


def _own(terms: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of a shard's words are asked for, and their numbers among those."""
    at = np.searchsorted(known, terms)
    own = np.flatnonzero(np.append(known, np.uint64(0))[at] == terms) if len(known) else np.zeros(0, dtype=np.int64)
    own = own[at[own] < len(known)]
    return own, at[own]


class Shard:
    """One shard ready for the words ``known``: their postings with scores, in blocks with maxima."""

    def __init__(self, row: dict, known: np.ndarray, idf: np.ndarray, mean_length: float) -> None:
        self.doc_ids = np.frombuffer(row["doc_ids"], np.int64)
        length = np.frombuffer(row["lengths"], np.uint32)
        own, self.terms = _own(np.frombuffer(row["terms"], np.uint64), known)
        every = np.frombuffer(row["counts"], np.uint32).astype(np.int64)
        counts = every[own]
        places = np.repeat((np.cumsum(every) - every)[own] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        self.docs = np.cumsum(_unpacked(row["docs"], row["n_postings"], np.int32), dtype=np.int64)[places]
        tf = _unpacked(row["tf"], row["n_postings"], np.uint32)[places].astype(np.float64)
        norm = K1 * (1 - B + B * length / mean_length) if mean_length else np.ones(len(length))
        term = np.repeat(np.arange(len(counts)), counts)
        self.score = idf[self.terms][term] * tf * (K1 + 1) / (tf + norm[self.docs])
        block = self.docs // BLOCK
        self.n_blocks = len(length) // BLOCK + 1
        fresh = np.concatenate([[True], (np.diff(block) != 0) | (np.diff(term) != 0)]) if len(term) else np.zeros(0, dtype=bool)
        self.start = np.flatnonzero(fresh)
        self.end = np.append(self.start[1:], len(term))[: len(self.start)]
        self.most = np.maximum.reduceat(self.score, self.start) if len(self.start) else np.zeros(0)
        self.block = block[self.start]
        self.first = np.searchsorted(self.start, np.concatenate([[0], np.cumsum(counts)]))

    def top(self, query: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k best (score, doc_id) for the numbers of distinct words, in rank order."""
        at = np.searchsorted(self.terms, query)
        own = at[(at < len(self.terms)) & (self.terms[np.minimum(at, max(0, len(self.terms) - 1))] == query)] if len(self.terms) else at[:0]
        if not len(own):
            return []
        lists = np.concatenate([np.arange(a, b) for a, b in zip(self.first[own], self.first[own + 1])])
        bound = np.bincount(self.block[lists], weights=self.most[lists], minlength=self.n_blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best: list[tuple[float, int]] = []
        done, step = 0, 1
        while done < len(order):
            least = -best[k - 1][0] if len(best) >= k else 0.0
            group = order[done : done + step]
            group = group[bound[group] + _ROUND >= least]
            if not len(group):
                break
            chosen = np.zeros(self.n_blocks, dtype=bool)
            chosen[group] = True
            entered = lists[chosen[self.block[lists]]]
            size = self.end[entered] - self.start[entered]
            posting = np.repeat(self.start[entered] - np.cumsum(size) + size, size) + np.arange(size.sum())
            doc, which = np.unique(self.docs[posting], return_inverse=True)
            pivot = np.bincount(which, weights=np.repeat(self.most[entered], size), minlength=len(doc)) + _ROUND >= least
            alive = pivot[which]
            score = np.round(np.bincount(which[alive], weights=self.score[posting[alive]], minlength=len(doc)), 6)
            good = np.flatnonzero(pivot & (score >= least) & (score > 0))
            best = sorted([*best, *zip((-score[good]).tolist(), self.doc_ids[doc[good]].tolist())])[:k]
            done, step = done + step, step * 2
        return [(-s, d) for s, d in best]


def _parts(queries: DataFrame) -> Iterator[list[tuple]]:
    """The queries (item_id, text), in parts of bounded size."""
    rows = queries.selectExpr("cast(item_id as bigint) item_id", "text").filter("text is not null").distinct()
    most = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(most / 2 / MAX_TERMS))
    for i in range(n):
        part = (rows if n == 1 else rows.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == i)).collect()
        if part:
            yield [tuple(r) for r in part]


_HIT = pa.schema([("query", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])


def search(docs: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """(item_id, doc_id, score, rank): the k best documents of each query; the documents are indexed first, into the shared folder."""
    return searched(common.checkpoint(index(docs)), queries, k)


def searched(shards: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """(item_id, doc_id, score, rank): the k best documents of each query, from the shards of an :func:`index`."""
    spark = shards.sparkSession
    result = spark.createDataFrame([], "item_id bigint, doc_id bigint, score double, rank int")
    for n, part in enumerate(_parts(queries)):
        w = kernels.words(kernels.as_strings(pa.array([t for _, t in part], pa.large_string())))
        known = np.unique(w.hash)
        asked = [(i, np.unique(np.searchsorted(known, w.hash[a:b]))) for (i, _), a, b in zip(part, w.bounds[:-1], w.bounds[1:])]
        idf, mean_length = _statistics(shards, known)
        shared = spark.sparkContext.broadcast((asked, known, idf, mean_length))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked, known, idf, mean_length = shared.value
            for batch in batches:
                for row in batch.to_pylist():
                    shard = Shard(row, known, idf, mean_length)
                    hits = [(q, item, d, s) for q, (item, terms) in enumerate(asked) for s, d in shard.top(terms, k)]
                    if hits:
                        yield common.record(_HIT, *map(list, zip(*hits)))

        by = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
        found = shards.mapInArrow(run, "query bigint, item_id bigint, doc_id bigint, score double").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("item_id", "doc_id", "score", "rank")
        result = found if n == 0 else result.unionByName(found)
    return result


def _statistics(shards: DataFrame, known: np.ndarray) -> tuple[np.ndarray, float]:
    """Inverse document frequencies by word and the mean length, over all shards."""
    pair = pa.schema([("term", pa.int64()), ("df", pa.int64())])
    shared = shards.sparkSession.sparkContext.broadcast(known)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, c in zip(b.column("terms").to_pylist(), b.column("counts").to_pylist()):
                own, at = _own(np.frombuffer(t, np.uint64), shared.value)
                yield common.record(pair, at.astype(np.int64), np.frombuffer(c, np.uint32).astype(np.int64)[own])

    total = shards.agg(F.sum("n_docs"), F.sum("n_words")).first()
    n, words = total[0] or 0, total[1] or 0
    # at most MAX_TERMS rows
    found = shards.select("terms", "counts").mapInArrow(frequencies, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(known))
    df[found["term"].to_numpy()] = found["df"].to_numpy()
    return np.log(1 + (n - df + 0.5) / (df + 0.5)), words / n if n else 0.0


def op9_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item as a query."""
    return search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH q AS (
  SELECT DISTINCT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+'))) AS t FROM benchmark WHERE text IS NOT NULL
), d AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ts FROM documents WHERE doc_id IS NOT NULL
), n AS (
  SELECT count(*) AS n, avg(len(ts)) AS mean FROM d
), tf AS (
  SELECT doc_id, len, t, count(*) AS tf FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL
), df AS (
  SELECT t, count(*) AS df FROM tf GROUP BY t
), s AS (
  SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
  FROM q JOIN tf USING (t) JOIN df USING (t) CROSS JOIN n GROUP BY item_id, doc_id
)
SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
FROM s QUALIFY rank <= 10
"""
