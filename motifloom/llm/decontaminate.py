"""Benchmark decontamination by spaced-seed hashing.

A fixed mask picks some of the words of a window and ignores the others, so
two windows that differ only at ignored words hash alike.  The hashes of all
masks at all word positions of the test items are joined with those of the
documents; around each hit the item is laid along the document and the best
run of words is found that agree, with substituted words in between.

Verification: along a diagonal (item word j beside document word i) a matching
word scores 1 and any other -2; the best-scoring segment is the overlap.  A
document is contaminated by an item if the overlap has at least
``min_matched`` matching words, or, for items shorter than that, the share
``short_share`` of the item's words.

The hashes of the test items are broadcast while they are ``MAX_HASHES`` at
most.  Beyond that they are joined with those of the documents by shuffling
both; of the documents' hashes only those go that a bit table of fixed size
allows.  Each pair of texts that share a hash is then verified in the same way,
so the result is the same.  What repeats within a text makes runs of diagonals,
which are found as intervals and verified together.

Defined results: null and empty texts (of either table) match nothing; items
with fewer words than the masks pick (6) match nothing, as nothing shorter is
evidence; repeated items and repeated rows are each reported; a null
``doc_id`` or ``item_id`` stays null; either table may be empty; other columns
are kept by :func:`drop_contaminated` and ignored by :func:`overlaps`,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels

#: A 1 is a word that counts, a 0 one that is ignored.
MASKS = ("111111", "11101101", "101101011", "1100110011")
MIN_MATCHED = 13
SHORT_SHARE = 0.8
MAX_HASHES = 4_000_000
_MISS = -2
_TABLE_BITS = 20
_FILTER_BITS = 27
_DIAGONAL_BITS = 41
_PIECE = 1 << 20


def _offsets(mask: str) -> tuple[int, ...]:
    return tuple(i for i, c in enumerate(mask) if c == "1")


@dataclass
class TestItems:
    """Words of the test items and the sorted spaced-seed hashes of their positions, consecutive equals as one run."""

    ids: list[int | None]
    words: list[np.ndarray]
    hashes: np.ndarray
    item: np.ndarray
    position: np.ndarray  #: of the first of a run
    length: np.ndarray  #: of the run
    present: np.ndarray  #: by the top bits of a hash: whether there may be one

    @classmethod
    def build(cls, ids: list[int | None], texts: list[str | None]) -> TestItems:
        w = kernels.words(kernels.as_strings(pa.array(texts, pa.large_string())))
        found, item, position, length = [], [], [], []
        for m, mask in enumerate(MASKS):
            h = kernels.rolled(w.hash, _offsets(mask)) ^ np.uint64(m)
            ok = np.flatnonzero(kernels.same_row(w.row, len(mask) - 1))
            fresh = np.concatenate([[True], (np.diff(ok) > 1) | (np.diff(w.row[ok]) > 0) | (h[ok[1:]] != h[ok[:-1]])]) if len(ok) else np.zeros(0, dtype=bool)
            length.append(np.diff(np.append(np.flatnonzero(fresh), len(ok))))
            ok = ok[fresh]
            found.append(h[ok])
            item.append(w.row[ok])
            position.append(ok - w.bounds[w.row[ok]])
        hashes = np.concatenate(found)
        order = np.argsort(hashes, kind="stable")
        present = np.zeros(1 << _TABLE_BITS, dtype=bool)
        present[hashes >> np.uint64(64 - _TABLE_BITS)] = True
        return cls(ids, [w.hash[a:b] for a, b in zip(w.bounds[:-1], w.bounds[1:])], hashes[order], np.concatenate(item)[order], np.concatenate(position)[order], np.concatenate(length)[order], present)

    def hits(self, w: kernels.Words) -> np.ndarray:
        """Distinct (item, row, document word beside the item's first), ordered.

        Words that go on repeating make runs of equal hashes, in the document
        and in the item; two runs meet along an interval of diagonals, so they
        are never multiplied out.
        """
        reach = max(map(len, self.words), default=0)
        # diagonals of one row after another, each row with room for those that begin before it
        base = w.bounds[:-1] + (np.arange(len(w.bounds) - 1) + 1) * reach
        found = np.zeros(0, dtype=np.int64)
        for m, mask in enumerate(MASKS):
            h = kernels.rolled(w.hash, _offsets(mask)) ^ np.uint64(m)
            maybe = np.flatnonzero(self.present[h >> np.uint64(64 - _TABLE_BITS)])
            maybe = maybe[w.row[maybe] == w.row[maybe + len(mask) - 1]]
            if not len(maybe):
                continue
            fresh = np.concatenate([[True], (np.diff(maybe) > 1) | (np.diff(w.row[maybe]) > 0) | (h[maybe[1:]] != h[maybe[:-1]])])
            first, length = maybe[fresh], np.diff(np.append(np.flatnonzero(fresh), len(maybe)))
            low = np.searchsorted(self.hashes, h[first], side="left")
            n = np.searchsorted(self.hashes, h[first], side="right") - low
            first, length, low, n = (x[n > 0] for x in (first, length, low, n))
            for at, run in _expanded(low, n):
                own = self.position[run]
                start = base[w.row[first[at]]] + first[at] - w.bounds[w.row[first[at]]] - own - self.length[run] + 1
                key = self.item[run] << _DIAGONAL_BITS | start
                for k, diagonal in _expanded(key, length[at] + self.length[run] - 1):
                    found = np.union1d(found, _distinct(diagonal)) if len(found) else _distinct(diagonal)
        item, place = found >> _DIAGONAL_BITS, found & (1 << _DIAGONAL_BITS) - 1
        row = np.searchsorted(base - reach, place, side="right") - 1
        return np.stack([item, row, place - base[row]], axis=1)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Ordered distinct values; by marking them where they lie close together."""
    low = x.min()
    if x.max() - low > 8 * _PIECE:
        return np.unique(x)
    seen = np.zeros(int(x.max() - low) + 1, dtype=bool)
    seen[x - low] = True
    return np.flatnonzero(seen) + low


def _expanded(low: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index, value): low[i], low[i] + 1, ... of n[i] values each, in pieces of bounded size."""
    end = np.cumsum(n)
    i = 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + _PIECE, side="right")))
        size = n[i:j]
        at = np.repeat(np.arange(i, j), size)
        yield at, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[at]
        i = j


def best_segments(match: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, matches) by row of the best-scoring runs: of equals the one with the most matches, then the first."""
    rows, width = match.shape
    total, matched = np.zeros((rows, width + 1), dtype=np.int32), np.zeros((rows, width + 1), dtype=np.int32)
    np.cumsum(match, axis=1, out=matched[:, 1:])
    total[:, 1:] = matched[:, 1:] * (1 - _MISS) + _MISS * np.arange(1, width + 1, dtype=np.int32)
    lowest = np.minimum.accumulate(total, axis=1)
    gain = total - lowest
    # where the lowest total so far was reached first
    start = np.maximum.accumulate(np.where(np.diff(lowest, axis=1, prepend=1) < 0, np.arange(width + 1), 0), axis=1)
    n = np.where(gain == gain.max(axis=1, keepdims=True), matched - np.take_along_axis(matched, start, axis=1), -1)
    end, every = np.argmax(n, axis=1), np.arange(rows)
    some = gain.max(axis=1) > 0
    return np.where(some, start[every, end], 0), np.where(some, end, 0), np.where(some, n[every, end], 0)


def needed(n_words: int, min_matched: int = MIN_MATCHED, short_share: float = SHORT_SHARE) -> int:
    """Matching words that contaminate, for an item of so many words."""
    return min(min_matched, max(6, math.ceil(short_share * n_words)))


_OVERLAP = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64()), ("n_matched", pa.int64())])


def _verified(items: TestItems, w: kernels.Words) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """By (row, item): the overlap with the most matching words, the earliest of equals."""
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    hits = items.hits(w)
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(hits[:, :2], axis=0) != 0).any(axis=1)])) if len(hits) else np.zeros(0, dtype=np.int64)
    for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(hits)]):
        item, row = int(hits[i, 0]), int(hits[i, 1])
        own, doc = items.words[item], w.hash[w.bounds[row] : w.bounds[row + 1]]
        most, least = needed(len(own)) - 1, np.arange(len(own))
        step = max(1, _PIECE // len(own))
        for at in range(i, j, step):
            diagonal = hits[at : min(j, at + step), 2]
            place = diagonal[:, None] + least
            match = (doc[np.clip(place, 0, len(doc) - 1)] == own) & (place >= 0) & (place < len(doc))
            able = np.flatnonzero(match.sum(axis=1) > most)
            if not len(able):
                continue
            start, end, matched = best_segments(match[able])
            k = int(np.argmax(matched))
            if matched[k] > most:
                most = int(matched[k])
                best[row, item] = (int(diagonal[able[k]] + start[k]), int(start[k]), int(end[k] - start[k]), most)
            if most == len(own):
                break
    return best


_RESULT = "doc_id bigint, item_id bigint, doc_word bigint, item_word bigint, n_words bigint, n_matched bigint"


def _items(benchmark: DataFrame) -> tuple[DataFrame, TestItems | None]:
    """The test items that have a text; and, where their hashes are ``MAX_HASHES`` at most, these as one."""
    rows = benchmark.selectExpr("cast(item_id as bigint) item_id", "text").filter("text is not null")
    # a word and the gap after it take two characters at least
    most = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if most / 2 * len(MASKS) > MAX_HASHES:
        return rows, None
    found = rows.collect()
    return rows, TestItems.build([r[0] for r in found], [r[1] for r in found])


def _texts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): each text once, with the digest that names it."""
    return rows.filter("text is not null").select(F.sha2("text", 256).alias(key), F.col("text").alias(text)).dropDuplicates([key])


def _seeds(texts: DataFrame, key: str, text: str, known: np.ndarray | None = None) -> DataFrame:
    """(h, key): the distinct spaced-seed hashes of each text, of those that ``known`` (bits by leading digits of the hash) allows."""
    schema = pa.schema([("h", pa.int64()), (key, pa.string())])
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def work(column: pa.Array, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        w, found = kernels.words(column), []
        for m, mask in enumerate(MASKS):
            h = kernels.rolled(w.hash, _offsets(mask)) ^ np.uint64(m)
            ok = kernels.same_row(w.row, len(mask) - 1)
            if shared.value is not None:
                ok &= common.may_have(shared.value, h, _FILTER_BITS)
            found.append(np.stack([h[ok].view(np.int64), w.row[: len(h)][ok]]))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return common.record(schema, pairs[0], batch.column(key).take(pa.array(pairs[1])))

    return texts.mapInArrow(common.over_slices(work, text), f"h bigint, {key} string")


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(dk, ik, doc_word, item_word, n_words, n_matched) of texts that overlap: hashes joined by shuffling, then each pair verified."""
    doc, item = _texts(docs, "dk", "doc"), _texts(items, "ik", "item")
    own = common.checkpoint(_seeds(item, "ik", "item"))
    pairs = common.checkpoint(_seeds(doc, "dk", "doc", common.bit_table(own, _FILTER_BITS)).join(own, "h").select("dk", "ik").distinct())
    schema = pa.schema([("dk", pa.string()), ("ik", pa.string()), *list(_OVERLAP)[2:]])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                for place in _verified(TestItems.build([0], [r["item"]]), kernels.words(kernels.as_strings(pa.array([r["doc"]], pa.large_string())))).values():
                    yield common.record(schema, *([x] for x in (r["dk"], r["ik"], *place)))

    asked = pairs.join(item, "ik").join(doc, "dk").select("dk", "ik", "doc", "item")
    return asked.mapInArrow(verify, "dk string, ik string, doc_word bigint, item_word bigint, n_words bigint, n_matched bigint")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words, n_matched) for each document row and each item that contaminates it; places and lengths in words."""
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    items, whole = _items(benchmark)
    if whole is None:
        found = _joined(rows, items)
        named = items.select("item_id", F.sha2("text", 256).alias("ik")).join(found, "ik")
        return rows.select("doc_id", F.sha2("text", 256).alias("dk")).join(named, "dk").selectExpr(*(c.split()[0] for c in _RESULT.split(", ")))
    shared = docs.sparkSession.sparkContext.broadcast(whole)

    def work(texts: pa.Array, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        best = _verified(shared.value, kernels.words(texts))
        if not best:
            return None
        ids = batch.column("doc_id").to_pylist()
        return common.record(_OVERLAP, *map(list, zip(*((ids[row], shared.value.ids[item], *place) for (row, item), place in best.items()))))

    return rows.mapInArrow(common.over_slices(work), _RESULT)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that any item contaminates; without a shuffle where the items are broadcast."""
    items, whole = _items(benchmark)
    if whole is None:
        key, gone = common.unused(docs, "dk"), _joined(docs.select("text"), items).select("dk").distinct()
        return docs.withColumn(key, F.sha2("text", 256)).join(gone.select(F.col("dk").alias(key)), key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    shared = docs.sparkSession.sparkContext.broadcast(whole)

    def work(texts: pa.Array, batch: pa.RecordBatch) -> pa.RecordBatch:
        bad = {row for row, _ in _verified(shared.value, kernels.words(texts))}
        return batch.filter(pa.array([i not in bad for i in range(len(texts))])) if bad else batch

    return docs.mapInArrow(common.over_slices(work), docs.schema)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All overlaps of documents with benchmark items."""
    return overlaps(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
