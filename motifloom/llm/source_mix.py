"""Mixing sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1.  The weight of each source is given at the
knots of a schedule and is linear between them, so at any time the weights of
all sources add up to 1.  Integrating a source's weight gives its cumulative
token demand (piecewise quadratic); a document whose source has supplied ``c``
tokens before it belongs at the time where that demand reaches ``c``, found by
inverting the quadratic.  Documents are then range-sorted by that position.

The number of tokens trained on is the smallest at which every document is
used once at least; sources whose demand exceeds their supply come round again
(``epoch`` 1, 2, ...), always in the same order.  By default the knots hold
temperature-scaled shares of the supply: proportional to tokens ** 1.0, 0.7
and 0.5 at times 0, 0.5 and 1.

Within a source the order is that of ``md5(doc_id)``.  Running sums over it are
taken in two levels, first over ranges of the hash and then inside each range.
A source of more rows is cut by more digits of the hash, so that a range has
``RANGE_ROWS`` rows at most, on average, however large the source is.  What is
known of sources and ranges is broadcast while it is ``MAX_BROADCAST`` rows at
most and joined by shuffling otherwise.

Defined results: a null source is a source of its own; a null ``doc_id`` sorts
by the hash of the empty string; null and empty texts have 0 tokens and take
the position where they stand in their source; a source without any token has
weight 0 and its documents position 0; repeated rows are documents of their
own; an empty table gives an empty one; other columns are kept by
:func:`mixed`, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

KNOTS = (0.0, 0.5, 1.0)
EXPONENTS = (1.0, 0.7, 0.5)
RANGE_ROWS = 1_000
MAX_BROADCAST = 100_000  #: rows of about 200 bytes


def n_tokens(text: Column) -> Column:
    """Runs between white space, counted without building any."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("bigint")


def schedule(supply: DataFrame, exponents: Sequence[float] = EXPONENTS) -> DataFrame:
    """(source, s, w0, w1, ...): tokens and weight at each knot, of sources (source, s)."""
    out = supply
    for k, e in enumerate(exponents):
        raw = F.when(F.col("s") > 0, F.pow(F.col("s").cast("double"), F.lit(float(e)))).otherwise(0.0)
        out = out.withColumn(f"r{k}", raw)
    totals = out.agg(*[F.sum(f"r{k}").alias(f"t{k}") for k in range(len(exponents))])
    out = out.crossJoin(F.broadcast(totals))  # one row
    return out.select("source", "s", *[F.when(F.col(f"t{k}") > 0, F.col(f"r{k}") / F.col(f"t{k}")).otherwise(0.0).alias(f"w{k}") for k in range(len(exponents))])


def _demand(knots: Sequence[float]) -> list[Column]:
    """The integral of the weight from 0 to each knot."""
    total, out = F.lit(0.0), [F.lit(0.0)]
    for k in range(len(knots) - 1):
        total = total + (F.col(f"w{k}") + F.col(f"w{k + 1}")) * (knots[k + 1] - knots[k]) / 2
        out.append(total)
    return out


def _inverse(x: Column, knots: Sequence[float]) -> Column:
    """The time at which the integral of the weight reaches ``x``."""
    at, result = _demand(knots), F.lit(1.0)
    for k in reversed(range(len(knots) - 1)):
        h = knots[k + 1] - knots[k]
        a, b, y = (F.col(f"w{k + 1}") - F.col(f"w{k}")) / (2 * h), F.col(f"w{k}"), x - at[k]
        root = F.sqrt(F.greatest(b * b + 4 * a * y, F.lit(0.0)))
        t = F.when(b + root > 0, 2 * y / (b + root)).otherwise(0.0)
        result = F.when(x < at[k + 1], knots[k] + t).otherwise(result)
    return F.least(F.greatest(result, F.lit(0.0)), F.lit(1.0))


def _listed(known: DataFrame) -> DataFrame:
    return F.broadcast(known) if known.count() <= MAX_BROADCAST else known


def _placed(rows: DataFrame, knots: Sequence[float], exponents: Sequence[float]) -> DataFrame:
    """Adds ``_epoch`` and ``_position`` to rows that have ``_source``, ``_key``, ``_id`` and ``_n``."""
    size = common.checkpoint(rows.groupBy("_source").agg(F.count("*").alias("_rows")))  # texts aren't read for it
    digits = F.greatest(F.ceil(F.log(F.col("_rows") / RANGE_ROWS) / math.log(16)), F.lit(0)).cast("int")
    rows = rows.join(_listed(size.select("_source", digits.alias("_digits"))), "_source").withColumn("_range", F.expr("substring(_key, 1, _digits)")).drop("_digits")
    ranges = common.checkpoint(rows.groupBy("_source", "_range").agg(F.sum("_n").alias("in_range")))
    supply = ranges.groupBy(F.col("_source").alias("source")).agg(F.sum("in_range").alias("s"))
    weights = schedule(supply, exponents).withColumn("all", _demand(knots)[-1])
    # tokens trained on: so many that no source has supply left over
    tokens = weights.agg(F.max(F.when(F.col("all") > 0, F.col("s") / F.col("all"))).alias("tokens"))
    weights = weights.crossJoin(F.broadcast(tokens)).withColumnRenamed("source", "_source")
    before = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = common.checkpoint(ranges.withColumn("_before", F.coalesce(F.sum("in_range").over(before), F.lit(0))).drop("in_range").join(weights, "_source"))
    inside = Window.partitionBy("_source", "_range").orderBy("_key", "_id", "_n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(_listed(starts), ["_source", "_range"])
    start = F.col("_before") + F.col("_in")
    again = F.when(F.col("s") > 0, F.greatest(F.ceil((F.col("tokens") * F.col("all") - start) / F.col("s") - 1e-9) - 1, F.lit(0))).otherwise(0).cast("int")
    rows = rows.withColumn("_epoch", F.explode(F.sequence(F.lit(0), again)))
    x = (start + F.col("_epoch") * F.col("s")) / F.col("tokens")
    return rows.withColumn("_position", F.round(F.when(F.col("s") > 0, _inverse(x, knots)).otherwise(0.0), 9))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns(
        {
            "_source": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")),  # a null source is like no other
            "_id": F.col("doc_id").cast("bigint"),
            "_key": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))),
            "_n": n_tokens(F.col("text")),
        }
    )


def positions(docs: DataFrame, knots: Sequence[float] = KNOTS, exponents: Sequence[float] = EXPONENTS) -> DataFrame:
    """(doc_id, source, n_tokens, epoch, position), range-sorted by position; texts are not moved."""
    rows = _placed(_keyed(docs.select("doc_id", "source", "text")).drop("text"), knots, exponents)
    return rows.select(F.col("_id").alias("doc_id"), "source", F.col("_n").alias("n_tokens"), F.col("_epoch").alias("epoch"), F.col("_position").alias("position")).orderBy("position", "doc_id", "epoch")


def mixed(docs: DataFrame, knots: Sequence[float] = KNOTS, exponents: Sequence[float] = EXPONENTS) -> DataFrame:
    """All columns of ``docs``, then ``mix_epoch`` and ``mix_position``, range-sorted by position."""
    names = docs.columns
    # renamed so that no column of the documents meets one of the plan's
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "doc_id", "source", "text")
    rows = _placed(_keyed(whole).drop("doc_id", "source", "text"), knots, exponents)
    return rows.orderBy("_position", "_id", "_epoch").select(*[F.col("_row").getField(c).alias(c) for c in names], F.col("_epoch").alias("mix_epoch"), F.col("_position").alias("mix_position"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training positions of all documents under the default curriculum."""
    return positions(common.table(spark, sf_dir, "documents"))


#: DuckDB SQL of ``positions`` over a view or subquery ``{docs}``
SQL = r"""
WITH d AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, source, coalesce(source, chr(1)) AS src, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CASE WHEN t = '' THEN 0 ELSE length(t) - length(replace(t, ' ', '')) + 1 END AS n
  FROM (SELECT doc_id, source, trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS t FROM {docs})
), s AS (
  SELECT src, CAST(sum(n) AS DOUBLE) AS s FROM d GROUP BY src
), r AS (
  SELECT src, s, CASE WHEN s > 0 THEN s ELSE 0 END AS r0, CASE WHEN s > 0 THEN pow(s, 0.7) ELSE 0 END AS r1, CASE WHEN s > 0 THEN pow(s, 0.5) ELSE 0 END AS r2 FROM s
), w AS (
  SELECT src, s, coalesce(r0 / nullif(sum(r0) OVER (), 0), 0) AS w0, coalesce(r1 / nullif(sum(r1) OVER (), 0), 0) AS w1, coalesce(r2 / nullif(sum(r2) OVER (), 0), 0) AS w2 FROM r
), a AS (
  SELECT *, (w0 + w1) / 4 AS d1, (w0 + w1) / 4 + (w1 + w2) / 4 AS d2 FROM w
), g AS (
  SELECT *, max(CASE WHEN d2 > 0 THEN s / d2 END) OVER () AS tokens FROM a
), c AS (
  SELECT d.*, g.* EXCLUDE (src), coalesce(sum(n) OVER (PARTITION BY d.src ORDER BY k, doc_id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
  FROM d JOIN g ON d.src = g.src
), e AS (
  SELECT *, unnest(range(0, CAST(CASE WHEN s > 0 THEN greatest(ceil((tokens * d2 - c) / s - 1e-9) - 1, 0) ELSE 0 END AS BIGINT) + 1)) AS epoch FROM c
), x AS (
  SELECT *, (c + epoch * s) / tokens AS x FROM e
), p AS (
  SELECT *, CASE WHEN x < d1 THEN w0 ELSE w1 END AS b, CASE WHEN x < d1 THEN w1 - w0 ELSE w2 - w1 END AS m, CASE WHEN x < d1 THEN x ELSE x - d1 END AS y FROM x
), q AS (
  SELECT *, b + sqrt(greatest(b * b + 4 * m * y, 0)) AS z FROM p
)
SELECT doc_id, source, CAST(n AS BIGINT) AS n_tokens, CAST(epoch AS INTEGER) AS epoch,
       round(CASE WHEN s > 0 THEN CASE WHEN x < d2 THEN least(greatest(CASE WHEN x < d1 THEN 0 ELSE 0.5 END + CASE WHEN z > 0 THEN 2 * y / z ELSE 0 END, 0), 1) ELSE 1 END ELSE 0 END, 9) AS position
FROM q
"""
ORACLE_SQL = SQL.replace("{docs}", "documents")
