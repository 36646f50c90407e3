"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

A text is described by a dozen statistics (``STATISTICS``).  After
standardising, random Fourier features approximate a Gaussian kernel over
them.  Each partition sums its share of the normal equations; the sums are
added, and the system, of fixed size, solved on the driver gives ridge scores.  Scores
of labelled documents that were held out of the fit are then turned into
probabilities by isotonic regression (pool adjacent violators over a fixed
grid of scores).

Every labelled document takes part: one in five, by the hash of its id, in the
calibration and the others in the fit.  What reaches the driver has a fixed
size: the normal equations, the grid, and a table of bits that spares most
documents without a label from being described for the fit.

Letters beyond ASCII, of any script, count as lower-case ones, and words are
measured in characters, not in bytes.

Defined results: null and empty texts have all statistics 0 and are scored
like any other; labels that are null or of no document are not used; without
any usable label every probability is 0.5 and every document is kept; a
document is kept if its probability is at least ``KEEP``; a null ``doc_id``
stays null; repeated rows are scored each; :func:`keep_good` keeps all columns,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels

STATISTICS = ("log_words", "word_length", "upper", "digits", "symbols", "bars", "spaces", "line_length", "distinct_words", "repeated_next", "long_words", "stop_share")
FEATURES = 128  #: random Fourier features
BANDWIDTH = 4.0  #: of the Gaussian kernel, in standard deviations
LEAST_SCALE = 0.02  #: added to each standard deviation: two in a hundred characters are no outlier
RIDGE = 1e-3  #: a row
GRID = 4096  #: cells of the score, from -1 to 2
KEEP = 0.5
SEED = 20240229
_LABEL_BITS = 24  #: of the table that tells which documents may have a label


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` a text."""
    n = len(texts)
    raw, offsets = kernels.buffers(texts)
    raw, offsets = raw[int(offsets[0]) : int(offsets[-1])], offsets - offsets[0]
    size = np.diff(offsets)

    def count(inside: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    kind = _KIND[raw]
    chars = np.maximum(1, count((raw & 0xC0) != 0x80))
    upper, digits, symbols, bars, spaces, lines, letters = (count(kind == k) for k in range(1, 8))
    letters += upper
    w = kernels.words(texts)
    n_words = np.diff(w.bounds)
    per = np.maximum(1, n_words)
    begun = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    width = begun[w.end] - begun[w.start]
    sums = lambda x: np.bincount(w.row, weights=x, minlength=n)
    key = np.unique(w.row.astype(np.uint64) << np.uint64(44) | w.hash >> np.uint64(20))
    distinct = np.bincount((key >> np.uint64(44)).astype(np.int64), minlength=n)
    again = np.concatenate([(w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1]), [False]]) if len(w.hash) else np.zeros(0, dtype=bool)
    return np.stack(
        [
            np.log1p(n_words),
            np.minimum(20, sums(width) / per),
            upper / np.maximum(1, letters),
            digits / chars,
            symbols / chars,
            bars / chars,
            spaces / chars,
            np.log1p(size / (lines + 1)),
            distinct / per * np.log1p(per),
            sums(again) / per,
            sums(width > 12) / per,
            sums(width <= 3) / per,
        ],
        axis=1,
    )


_KIND = np.zeros(256, dtype=np.uint8)
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#$%&*@^~<>{}[]\\=+_!", "|", " \t", "\n", "abcdefghijklmnopqrstuvwxyz"), 1):
    _KIND[[ord(c) for c in _chars]] = _k
_KIND[[*range(0xC3, 0xE2), *range(0xE3, 0xEE)]] = 7  # how letters beyond ASCII begin; signs and pictures begin otherwise


@dataclass
class Model:
    """All that scoring needs; of fixed size."""

    mean: np.ndarray
    scale: np.ndarray
    direction: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    curve: np.ndarray  #: probability by cell of the grid

    def score(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale, self.direction, self.phase) @ self.weight

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.curve[cell(self.score(x))]


def fourier(x: np.ndarray, direction: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised rows, and a constant."""
    z = np.sqrt(2 / len(phase)) * np.cos(np.clip(x, -8, 8) @ direction + phase)
    return np.concatenate([z, np.ones((len(x), 1))], axis=1)


def cell(score: np.ndarray) -> np.ndarray:
    """Cell of the grid that a score falls in."""
    return np.clip(((score + 1) / 3 * GRID).astype(np.int64), 0, GRID - 1)


def isotonic(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Non-decreasing least-squares fit of total / count by cell; linear between cells that have any, level beyond them; 0.5 where there is nothing."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(count):
        blocks.append([float(total[i]), float(count[i]), int(i), int(i)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t, n, _, last = blocks.pop()
            blocks[-1][0] += t
            blocks[-1][1] += n
            blocks[-1][3] = last
    if not blocks:
        return np.full(len(count), 0.5)
    ends = [(x, t / n) for t, n, first, last in blocks for x in dict.fromkeys((first, last))]
    return np.interp(np.arange(len(count)), *zip(*ends))


_LABELLED = pa.schema([("doc_id", pa.int64()), ("x", pa.binary())])
_SUMS = pa.schema([("s", pa.binary())])


def _summed(rows: DataFrame, part) -> np.ndarray | None:
    """The total over all rows of ``part(x, y)``: summed in each partition, then over a few, then here."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column("x").to_pylist()), dtype=np.float64).reshape(b.num_rows, -1)
                s = part(x, b.column("y").to_numpy().astype(np.float64))
                total = s if total is None else total + s
        if total is not None:
            yield common.record(_SUMS, common.binary([total]))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for raw in b.column("s"):
                s = np.frombuffer(raw.as_py(), dtype=np.float64)
                total = s.copy() if total is None else total + s
        if total is not None:
            yield common.record(_SUMS, common.binary([total]))

    found = rows.mapInArrow(first, "s binary").repartition(4).mapInArrow(again, "s binary").toArrow()["s"].to_pylist()
    return sum(np.frombuffer(raw, dtype=np.float64) for raw in found) if found else None


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled documents of ``docs``."""

    known = labels.selectExpr("cast(doc_id as bigint) doc_id", "cast(quality as int) y").filter("doc_id is not null and y is not null")
    # documents that surely have no label aren't described; the join sorts out the others
    shared = docs.sparkSession.sparkContext.broadcast(common.bit_table(known.select(F.xxhash64("doc_id").alias("h")), _LABEL_BITS))

    def describe(texts: pa.Array, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        asked = pa.array(common.may_have(shared.value, batch.column("h").to_numpy().view(np.uint64), _LABEL_BITS))
        texts, doc_ids = texts.filter(asked), batch.column("doc_id").filter(asked)
        return common.record(_LABELLED, doc_ids, common.binary(list(statistics(texts)))) if len(texts) else None

    # a hundred bytes a document, and no text, go through the join
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "xxhash64(cast(doc_id as bigint)) h", "text").filter("doc_id is not null").mapInArrow(common.over_slices(describe), "doc_id bigint, x binary").join(known, "doc_id")
    rows = common.checkpoint(rows.select("x", "y", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("held")))
    fitted = rows.filter("not held")

    d = len(STATISTICS)
    rng = np.random.default_rng(SEED)
    direction, phase = rng.normal(0, 1 / BANDWIDTH, (d, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    model = Model(np.zeros(d), np.ones(d), direction, phase, np.zeros(FEATURES + 1), np.full(GRID, 0.5))
    moments = _summed(fitted, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    if moments is None:
        return model
    model.mean = moments[1 : d + 1] / moments[0]
    model.scale = np.sqrt(np.maximum(moments[d + 1 :] / moments[0] - model.mean**2, 0)) + LEAST_SCALE

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = fourier((x - model.mean) / model.scale, direction, phase)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = _summed(fitted, normal)
    k = FEATURES + 1
    model.weight = np.linalg.solve(sums[: k * k].reshape(k, k) + RIDGE * moments[0] * np.eye(k) / k, sums[k * k :])

    def cells(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        c = cell(model.score(x))
        return np.concatenate([np.bincount(c, minlength=GRID), np.bincount(c, weights=y, minlength=GRID)])

    grid = _summed(rows.filter("held"), cells)
    if grid is not None:
        model.curve = isotonic(grid[:GRID], grid[GRID:])
    return model


_SCORE = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("probability", pa.float64())])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, probability) of each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: pa.Array, batch: pa.RecordBatch) -> pa.RecordBatch:
        s = shared.value.score(statistics(texts))
        return common.record(_SCORE, batch.column("doc_id"), np.round(s, 6), np.round(shared.value.curve[cell(s)], 6))

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(common.over_slices(work), "doc_id bigint, score double, probability double")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, as they are, that the model keeps; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: pa.Array, batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(np.round(shared.value.probability(statistics(texts)), 6) >= KEEP))

    return docs.mapInArrow(common.over_slices(work), docs.schema)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with score and probability."""
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, fit(docs, common.table(spark, sf_dir, "labels"))).filter(F.col("probability") >= KEEP)
