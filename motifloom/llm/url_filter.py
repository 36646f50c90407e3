"""URL filters: the log-likelihood ratio of two character language models.

Two variable-order Markov models, one of accepted and one of rejected URLs,
give the probability of each byte of a URL after the longest known context of
at most ``ORDER`` bytes, smoothed by recursive interpolation with the shorter
contexts (Witten-Bell).  A URL's score is the difference of its two
log-likelihoods a byte; it is rejected if the score exceeds a threshold
calibrated on held-out URLs.

Examples are a table (url, rejected).  Where none is given, all URLs of the
table itself are, told apart by whether the host has one of ``BLOCKED`` among
its parts; the models then learn what such URLs look like beyond the list.  All
examples are counted, none sampled: the counts grow with the input, by Spark's
partial aggregation.  A context, its order and the byte after it make one
64-bit number, so the models are sorted arrays and URLs are scored with NumPy.
The models are broadcast while they are ``MAX_MODEL`` rows at most; beyond that
the URLs are taken in blocks, and each block is joined with the rows that it
needs, with the same scores.

Calibration: one URL in ten, by hash, is left out of the counts; the threshold
is the smallest score on a fixed grid at which at most ``MAX_LOSS`` of the
held-out accepted URLs are rejected (0 if there are none).

Defined results: null URLs have no score and are neither accepted nor
rejected, so they are in neither result; the empty URL is scored by its end
alone; examples without a URL or a label are not used; without examples of a
class that model is uniform; repeated rows are counted and scored each; a null
``page_id`` stays null; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels

ORDER = 5
ALPHABET = 256  #: of the uniform distribution below order 0
BLOCKED = ("casino", "bets", "pills", "adult", "spam", "ads", "porn", "poker", "viagra", "warez")
MAX_MODEL = 3_000_000  #: rows, of 24 bytes
BLOCK_URLS = 5_000  #: about so many are scored together beyond that
MAX_LOSS = 0.001
CELLS, LOW, HIGH = 2000, -10.0, 10.0
_START, _END = "\x02", "\x03"


def normalised(url: Column) -> Column:
    """Lower case without the scheme, runs of digits as one 0; marked at both ends."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(url, r"^\s+|\s+$", "")), r"(?s)^.*?://", "")
    return F.concat(F.lit(_START), F.regexp_replace(bare, "[0-9]+", "0"), F.lit(_END))


def grams(urls: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(order, row, place, gram) of every byte but the first of each marked URL, for every order; a gram is the order, the context and the byte."""
    data, offsets = kernels.buffers(urls)
    data, offsets = data[int(offsets[0]) : int(offsets[-1])].astype(np.uint64), offsets - offsets[0]
    row = np.repeat(np.arange(len(urls)), np.diff(offsets))
    at = np.arange(len(data)) - offsets[:-1][row]
    place = np.flatnonzero(at > 0)
    key = data[place]
    for n in range(ORDER + 1):
        if n:
            own = at[place] >= n
            place, key = place[own], key[own]
            key = key | data[place - n] << np.uint64(8 * n)
        yield n, row[place], place, key | np.uint64(n << 56)


def _context(gram: np.ndarray) -> np.ndarray:
    return gram & ~np.uint64(0xFF)


def blocked(url: Column) -> Column:
    """Whether a part of the host, between dots and dashes, is on the list."""
    host = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*://)?([^/?#]*)", 1)
    return F.arrays_overlap(F.split(host, "[.-]"), F.array(*[F.lit(b) for b in BLOCKED]))


def _held(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(10)) == 0


_COUNTS = pa.schema([("gram", pa.int64()), ("rejected", pa.int64()), ("accepted", pa.int64())])


def counts(examples: DataFrame) -> DataFrame:
    """(gram, rejected, accepted) over all grams of examples (url, rejected)."""

    def count(urls: pa.Array, batch: pa.RecordBatch) -> pa.RecordBatch:
        bad, found = batch.column("rejected").to_numpy(zero_copy_only=False), list(grams(urls))
        gram, which = np.unique(np.concatenate([g for *_, g in found]), return_inverse=True)
        n = np.bincount(which * 2 + bad[np.concatenate([r for _, r, _, _ in found])], minlength=2 * len(gram)).reshape(-1, 2)
        return common.record(_COUNTS, gram.view(np.int64), n[:, 1], n[:, 0])

    rows = examples.select(normalised(F.col("url")).alias("url"), "rejected")
    return rows.mapInArrow(common.over_slices(count, "url"), "gram bigint, rejected bigint, accepted bigint").groupBy("gram").agg(F.sum("rejected").alias("rejected"), F.sum("accepted").alias("accepted"))


def totals(counted: DataFrame) -> DataFrame:
    """(context, rt, rk, at, ak): how often a context was seen in each class, and with how many different bytes after it."""
    context = F.col("gram").bitwiseAND(F.lit(~0xFF))
    return counted.groupBy(context.alias("context")).agg(F.sum("rejected").alias("rt"), F.count_if(F.col("rejected") > 0).alias("rk"), F.sum("accepted").alias("at"), F.count_if(F.col("accepted") > 0).alias("ak"))


class Model:
    """Interpolated probabilities of both classes, from counts by gram and totals by context."""

    def __init__(self, counted: pa.Table, total: pa.Table) -> None:
        self.gram, self.counts = self._ordered(counted, "gram", ("rejected", "accepted"))
        self.context, self.totals = self._ordered(total, "context", ("rt", "rk", "at", "ak"))

    @staticmethod
    def _ordered(rows: pa.Table, key: str, names: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        own = rows[key].to_numpy().view(np.uint64)
        by = np.argsort(own)
        # a row of zeros at the end is what keys not among them get
        return own[by], np.stack([np.append(rows[n].to_numpy()[by], 0).astype(np.float64) for n in names], axis=1)

    @staticmethod
    def _looked_up(keys: np.ndarray, asked: np.ndarray, values: np.ndarray) -> np.ndarray:
        at = np.searchsorted(keys, asked)
        known = np.append(keys, np.uint64(0))[at] == asked if len(keys) else np.zeros(len(asked), dtype=bool)
        return values[np.where(known & (at < len(keys)), at, len(keys))]

    def score(self, urls: pa.Array) -> np.ndarray:
        """Difference of the log-likelihoods, rejected less accepted, a byte, of each marked URL."""
        _, offsets = kernels.buffers(urls)
        size = int(offsets[-1] - offsets[0])
        bad, good, rows = np.full(size, 1 / ALPHABET), np.full(size, 1 / ALPHABET), np.zeros(0, dtype=np.int64)
        for n, row, place, gram in grams(urls):
            if n == 0:
                rows, every = row, place
            t = self._looked_up(self.context, _context(gram), self.totals)
            c = self._looked_up(self.gram, gram, self.counts)
            bad[place] = interpolated(bad[place], c[:, 0], t[:, 0], t[:, 1])
            good[place] = interpolated(good[place], c[:, 1], t[:, 2], t[:, 3])
        total = np.bincount(rows, weights=np.log(bad[every] / good[every]), minlength=len(urls))
        return np.round(total / (np.diff(offsets) - 1), 6)


def interpolated(lower: np.ndarray, count: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Witten-Bell: the lower order has the weight of the kinds seen."""
    return np.where(total > 0, (count + kinds * lower) / np.maximum(total + kinds, 1), lower)


_SCORE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("bad", pa.bool_()), ("score", pa.float64())])
_SCORE_SQL = "page_id bigint, url string, bad boolean, score double"


def _scored_by_broadcast(urls: DataFrame, counted: DataFrame) -> DataFrame:
    shared = urls.sparkSession.sparkContext.broadcast(Model(counted.toArrow(), totals(counted).toArrow()))

    def run(marked: pa.Array, b: pa.RecordBatch) -> pa.RecordBatch:
        return common.record(_SCORE, *(b.column(c) for c in ("page_id", "url", "bad")), shared.value.score(marked))

    return urls.mapInArrow(common.over_slices(run, "marked"), _SCORE_SQL)


def _scored_by_join(urls: DataFrame, counted: DataFrame) -> DataFrame:
    """In blocks of URLs: each with the rows of the models that its grams name."""
    n = max(1, -(-urls.count() // BLOCK_URLS))
    placed = urls.withColumn("block", F.pmod(F.xxhash64("url", "page_id"), F.lit(n)))
    need = pa.schema([("block", pa.int64()), ("gram", pa.int64())])

    def needs(marked: pa.Array, b: pa.RecordBatch) -> pa.RecordBatch:
        block = b.column("block").to_numpy()
        found = [np.stack([block[row], gram.view(np.int64)]) for _, row, _, gram in grams(marked)]
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return common.record(need, pairs[0], pairs[1])

    asked = common.checkpoint(placed.select("block", "marked").mapInArrow(common.over_slices(needs, "marked"), "block bigint, gram bigint").distinct())
    own = asked.join(counted, "gram").select("block", F.lit(True).alias("is_gram"), F.col("gram").alias("key"), F.col("rejected").alias("a"), F.lit(0).cast("bigint").alias("b"), F.col("accepted").alias("c"), F.lit(0).cast("bigint").alias("d"))
    contexts = asked.select("block", F.col("gram").bitwiseAND(F.lit(~0xFF)).alias("context")).distinct().join(totals(counted), "context")
    own = own.unionByName(contexts.select("block", F.lit(False).alias("is_gram"), F.col("context").alias("key"), F.col("rt").alias("a"), F.col("rk").alias("b"), F.col("at").alias("c"), F.col("ak").alias("d")))

    def run(pages: pa.Table, rows: pa.Table) -> pa.Table:
        inner = rows.filter(rows["is_gram"]).select(["key", "a", "c"]).rename_columns(["gram", "rejected", "accepted"])
        outer = rows.filter(pc.invert(rows["is_gram"])).select(["key", "a", "b", "c", "d"]).rename_columns(["context", "rt", "rk", "at", "ak"])
        model = Model(inner, outer)
        score = [model.score(part) for _, part in kernels.slices(kernels.as_strings(pages["marked"]))]
        return pa.table([pages["page_id"], pages["url"], pages["bad"], pa.array(np.concatenate([np.zeros(0), *score]))], names=_SCORE.names)

    return placed.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(run, _SCORE_SQL)


def listed(pages: DataFrame) -> DataFrame:
    """(url, rejected): the URLs of a table as examples, told apart by the list."""
    return pages.select("url", blocked(F.col("url")).alias("rejected"))


def score(pages: DataFrame, examples: DataFrame | None = None, max_model: int = MAX_MODEL) -> DataFrame:
    """(page_id, url, bad, score) of each page that has a URL; ``bad`` tells whether its host is on the list."""
    known = (listed(pages) if examples is None else examples).filter("url is not null and rejected is not null").filter(~_held(F.col("url")))
    urls = pages.selectExpr("cast(page_id as bigint) page_id", "url").filter("url is not null").withColumns({"bad": blocked(F.col("url")), "marked": normalised(F.col("url"))})
    counted = common.checkpoint(counts(known.select("url", F.col("rejected").cast("boolean").alias("rejected"))))
    return (_scored_by_broadcast if counted.count() <= max_model else _scored_by_join)(urls, counted)


def threshold(scored: DataFrame) -> float:
    """The calibrated bound on the score, from scored examples (url, bad, score)."""
    cell = F.least(F.greatest(F.floor((F.col("score") - LOW) / (HIGH - LOW) * CELLS), F.lit(0)), F.lit(CELLS - 1))
    found = scored.filter(_held(F.col("url")) & ~F.col("bad")).groupBy(cell.alias("cell")).count().collect()
    left, allowed = 0, MAX_LOSS * sum(r["count"] for r in found)
    bound = 0.0
    for r in sorted(found, key=lambda r: -r["cell"]):
        left += r["count"]
        if left > allowed:
            bound = LOW + (r["cell"] + 1) * (HIGH - LOW) / CELLS
            break
    return bound


def rejected(pages: DataFrame, examples: DataFrame | None = None) -> DataFrame:
    """(page_id, url, score) of the pages whose URL the filter rejects."""
    scored = common.checkpoint(score(pages, examples))
    if examples is None:
        bound = threshold(scored)
    else:
        known = examples.filter("url is not null and rejected is not null").select("url", F.col("rejected").cast("boolean").alias("own"))
        held = known.filter(_held(F.col("url")) & ~F.col("own")).select(F.lit(0).alias("page_id"), "url")
        bound = threshold(score(held, examples).withColumn("bad", F.lit(False)))
    return scored.filter(F.col("score") >= bound).select("page_id", "url", "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rejected pages."""
    return rejected(common.table(spark, sf_dir, "pages"))
