"""Whether coding a text is likely to hurt: features, prediction, monitoring and alerts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TASKS = {"general": 1.0, "code": 1.5, "policy": 1.3, "math": 1.4, "creative": 0.8, "summarization": 0.9, "qa": 1.2, "classification": 0.7}
CAUTION = 1.3


def features(coded: DataFrame) -> DataFrame:
    """What a prediction is made from, of each coded document."""
    n, m, k = F.col("n_tokens"), F.col("n_coded"), F.col("n_patterns")
    share = lambda a, b, empty: F.when(b > 0, a / b).otherwise(empty)
    before, after = share(F.col("distinct_tokens"), n, 1.0), share(F.col("distinct_body"), m, 1.0)
    return coded.select(
        "doc_id",
        n.alias("original_length"),
        m.alias("compressed_length"),
        share(m, n, 1.0).alias("compression_ratio"),
        k.alias("n_patterns"),
        share(m - F.col("n_body"), m, 0.0).alias("dict_overhead"),
        share(F.col("pattern_tokens"), k, 0.0).alias("avg_pattern_length"),
        before.alias("original_diversity"),
        after.alias("compressed_diversity"),
        F.when(before > 0, after / before).otherwise(1.0).alias("diversity_change"),
        share(F.col("covered"), n, 0.0).alias("coverage"),
        *(["passed"] if "passed" in coded.columns else []),
    )


def predicted(found: DataFrame, task: str = "general", cautious: bool = False) -> DataFrame:
    """``features`` with degradation, the risks, a recommendation and the ratio to aim at.

    Needs compression_ratio, n_patterns, dict_overhead, avg_pattern_length,
    diversity_change and original_length; ``length_variance``, where it is a
    column, counts too.
    """
    r, o, k = F.col("compression_ratio"), F.col("dict_overhead"), F.col("n_patterns")
    uneven = F.col("length_variance") > 10 if "length_variance" in found.columns else F.lit(False)
    risks: list[tuple[Column, Column, str]] = [
        (r < 0.5, (0.5 - r) * 0.15, "aggressive"),
        (r < 0.3, (0.3 - r) * 0.2, "very aggressive"),
        ((F.col("avg_pattern_length") < 3) & (k > 10), F.lit(0.03), "fragmented"),
        (o > 0.3, F.lit(0.02), "large dictionary"),
        (o > 0.5, F.lit(0.03), "mostly dictionary"),
        (F.col("diversity_change") < 0.7, F.lit(0.02), "less diverse"),
        (uneven, F.lit(0.01), "uneven patterns"),
        ((F.col("original_length") < 100) & (k > 5), F.lit(0.02), "short text, many patterns"),
    ]
    total = F.lit(0.0)
    for when, value, _ in risks:
        total = total + F.when(when, value).otherwise(0.0)
    degradation = F.least(F.least(total, F.lit(1.0)) * TASKS.get(task, 1.0), F.lit(1.0))
    if cautious:
        degradation = F.least(degradation * CAUTION, F.lit(1.0))
    rows = found.withColumn("degradation", F.round(degradation, 9)).withColumn("risks", F.array_compact(F.array(*[F.when(w, F.lit(name)) for w, _, name in risks])))
    d = F.col("degradation")
    return rows.withColumn("recommendation", F.when(d < 0.02, "compress").when(d < 0.1, "partial").otherwise("skip")).withColumn(
        "suggested_ratio", F.when(d < 0.02, r).when(d < 0.05, F.least(F.lit(0.9), r + 0.1)).when(d < 0.1, F.least(F.lit(0.95), r + 0.2)).otherwise(1.0)
    )


def worthwhile(found: DataFrame, most: float = 0.05) -> DataFrame:
    """Predictions of at most this degradation."""
    return found.filter(F.col("degradation") <= most)


def sdk_score(found: DataFrame, least_ratio: float, most_overhead: float, most_loss: float) -> DataFrame:
    """The other profile, of compression_ratio, dict_share (dictionary over original), diversity_loss and avg_pattern_length: score, probability of harm, and accept, retry or skip."""
    r, o, d, size = (F.col(c) for c in ("compression_ratio", "dict_share", "diversity_loss", "avg_pattern_length"))
    above = lambda x: F.greatest(x, F.lit(0.0))
    within = lambda x: F.least(above(x), F.lit(1.0))
    score = 1.0 - above(F.lit(least_ratio) - r) * 0.5 - above(o - most_overhead) * 0.3 - above(d - most_loss) * 0.4 + F.when(size.between(3, 6), 0.1).otherwise(0.0)
    harm = F.when(r < 0.4, 0.3).when(r < 0.5, 0.15).otherwise(0.0) + F.when(o > 0.3, 0.2).otherwise(0.0) + F.when(d > 0.3, 0.25).when(d > 0.2, 0.1).otherwise(0.0) + F.when(size < 2.5, 0.15).otherwise(0.0)
    rows = found.withColumn("score", F.round(within(score), 9)).withColumn("probability", F.round(within(harm), 9))
    p = F.col("probability")
    return rows.withColumn("decision", F.when((F.col("score") >= 0.6) & (p < 0.3), "accept").when(p < 0.5, "retry").otherwise("skip"))


def with_similarity(scored: DataFrame, least: float = 0.85, original: str = "original_vector", coded: str = "coded_vector") -> DataFrame:
    """``sdk_score`` made better or worse by the cosine of the vectors of the original and of its coding (0 where one is zero)."""
    a, b = F.col(original).cast("array<double>"), F.col(coded).cast("array<double>")
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(total(a, a)) * F.sqrt(total(b, b))
    rows = scored.withColumn("similarity", F.when(size > 0, total(a, b) / size).otherwise(0.0))
    s, low = F.col("similarity"), F.col("similarity") < least
    within = lambda x: F.round(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), 9)
    rows = rows.withColumn("score", within(F.col("score") + F.when(low, (s - least) * 0.3).otherwise((s - least) * 0.1))).withColumn("probability", within(F.col("probability") + F.when(low, 0.2).otherwise(0.0)))
    p = F.col("probability")
    return rows.withColumn("decision", F.when((F.col("score") >= 0.6) & (p < 0.3), "accept").when(p < 0.5, "retry").otherwise("skip"))


_PERCENTS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def summary(records: DataFrame, by: list[str] | None = None, exact: bool = False) -> DataFrame:
    """One row (a group) of what records (compression_ratio, degradation, overhead, patterns_used, original_length, compressed_length, passed, latency_ms) come to.

    Percentiles come from mergeable sketches, so groups may be of any size;
    with ``exact=True`` they are exact, from all values of a group in one task.
    """
    at = F.percentile if exact else F.percentile_approx
    out: list[Column] = [F.count("*").alias("records")]
    for c in ("compression_ratio", "degradation", "overhead"):
        out += [F.avg(c).alias(f"{c}_mean"), *[at(c, F.lit(p)).alias(f"{c}_{name}") for name, p in _PERCENTS.items()], F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    out += [
        F.avg("patterns_used").alias("patterns_mean"),
        F.max("patterns_used").alias("patterns_max"),
        (F.count_if(~F.col("passed")) / F.count("*")).alias("failure_rate"),
        F.sum("original_length").alias("tokens_processed"),
        F.sum(F.col("original_length") - F.col("compressed_length")).alias("tokens_saved"),
        F.coalesce(F.avg(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))), F.lit(0.0)).alias("latency_mean"),
    ]
    return records.groupBy(*(by or [])).agg(*out)


#: metric of the summary, warning, critical
RULES = [("compression_ratio_mean", 0.85, 0.95), ("compression_ratio_p95", 0.9, 0.98), ("degradation_mean", 0.03, 0.08), ("degradation_p95", 0.05, 0.1), ("overhead_mean", 0.4, 0.6), ("failure_rate", 0.01, 0.05)]


def alerts(summaries: DataFrame, rules: list[tuple[str, float, float]] | None = None, below: bool = False, keys: list[str] | None = None) -> DataFrame:
    """(keys, metric, value, severity, threshold): a row for each rule that a summary breaks, the critical bound before the warning."""
    keys = keys or []
    listed = [r for r in rules or RULES if r[0] in summaries.columns]
    checks = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(w)).alias("warning"), F.lit(float(c)).alias("critical")) for m, w, c in listed])
    rows = summaries.select(*keys, F.explode(checks).alias("a")).select(*keys, "a.*")
    broken = lambda bound: F.col("value") <= F.col(bound) if below else F.col("value") >= F.col(bound)
    severity = F.when(broken("critical"), "critical").when(broken("warning"), "warning")
    return rows.withColumn("severity", severity).filter("severity is not null").select(*keys, "metric", "value", "severity", F.when(F.col("severity") == "critical", F.col("critical")).otherwise(F.col("warning")).alias("threshold"))


def cooled(raised: DataFrame, seconds: float, key: str = "metric", at: str = "ts") -> DataFrame:
    """Alerts at least so long after the one of the same key before them that was let through.

    One pass over each key in the order of time, a batch of rows at a time;
    the key and the time let through last are all that is remembered.
    """
    kind, names = raised.schema, raised.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = None
        last, begun = float("-inf"), False
        for b in batches:
            let = []
            for k, t in zip(b.column(key).to_pylist(), b.column("_t").to_pylist()):
                if not begun or k != now:
                    now, last, begun = k, float("-inf"), True
                let.append(t is not None and t - last >= seconds)
                if let[-1]:
                    last = t
            yield b.filter(pa.array(let, pa.bool_())).select(names)

    placed = raised.withColumn("_t", F.col(at).cast("double")).repartition(key).sortWithinPartitions(key, "_t")
    return placed.mapInArrow(keep, kind)


def baseline(records: DataFrame, metric: str, at: str = "ts", last: int = 100, least: int = 10) -> DataFrame:
    """(mean, stddev, p95, n) over the latest records, if there are enough."""
    newest = records.orderBy(F.desc(at)).limit(last)
    return newest.agg(F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("stddev"), F.sort_array(F.collect_list(metric)).alias("v"), F.count("*").alias("n")).filter(F.col("n") >= least).select("mean", "stddev", F.get("v", F.floor(F.col("n") * 0.95).cast("int")).alias("p95"), "n")


def anomalies(records: DataFrame, base: DataFrame, metric: str, bound: float = 2.0) -> DataFrame:
    """Records with their z score against a baseline (one row), those beyond ``bound``."""
    z = F.when(F.col("stddev") > 0, (F.col(metric) - F.col("mean")) / F.col("stddev")).otherwise(0.0)
    return records.crossJoin(F.broadcast(base.select("mean", "stddev"))).withColumn("z", z).filter(F.abs("z") > bound).drop("mean", "stddev")


def rolling(records: DataFrame, metric: str, key: str, at: str, rows: int = 100) -> DataFrame:
    """Each record with mean and maximum of the last ``rows`` of its key."""
    by = Window.partitionBy(key).orderBy(at).rowsBetween(1 - rows, 0)
    return records.withColumns({"rolling_mean": F.avg(metric).over(by), "rolling_max": F.max(metric).over(by), "rolling_n": F.count("*").over(by)})


def histogram(records: DataFrame, metric: str, bins: int = 10) -> DataFrame:
    """(bin, low, n): equal bins from least to most; all in bin 0 where every value is the same."""
    ends = records.agg(F.min(metric).alias("lo"), F.max(metric).alias("hi"))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    cell = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(metric) - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    rows = records.filter(F.col(metric).isNotNull()).crossJoin(F.broadcast(ends)).withColumn("bin", cell)
    return rows.groupBy("bin").agg(F.round(F.first("lo") + F.col("bin") * F.first(width), 6).alias("low"), F.count("*").alias("n"))


def session(operations: DataFrame) -> DataFrame:
    """Totals of operations (operation, input_tokens, output_tokens, savings_percent, time_ms, success); analyses and streams count as compressions."""
    ok = F.col("success")
    kind = lambda *names: ok & F.col("operation").isin(*names)
    packed = kind("compress", "compress_text", "compress_context", "compress_streaming", "analyze")
    saved = F.when(packed, F.greatest(F.col("input_tokens") - F.col("output_tokens"), F.lit(0)))
    seconds = F.sum(F.when(packed, F.col("time_ms"))) / 1000
    return operations.agg(
        F.count("*").alias("operations"),
        F.count_if(packed).alias("compressions"),
        F.count_if(kind("decompress")).alias("decompressions"),
        F.count_if(~ok).alias("errors"),
        F.coalesce(F.sum(F.when(packed, F.col("input_tokens"))), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum(saved), F.lit(0)).alias("tokens_saved"),
        F.avg(F.when(packed, F.col("savings_percent"))).alias("savings_mean"),
        F.max(F.when(packed, F.col("savings_percent"))).alias("savings_best"),
        F.min(F.when(packed, F.col("savings_percent"))).alias("savings_worst"),
        F.when(seconds > 0, F.sum(F.when(packed, F.col("input_tokens"))) / seconds).alias("tokens_a_second"),
    )


def health(mean_ratio: Column) -> Column:
    """A word for a mean ratio."""
    return F.when(mean_ratio > 0.95, "poor").when(mean_ratio > 0.85, "fair").when(mean_ratio > 0.7, "good").otherwise("excellent")


def advice(savings_percent: Column) -> Column:
    """Whether coding is worth it."""
    return F.when(savings_percent > 15, "highly_recommended").when(savings_percent > 5, "recommended").when(savings_percent > 1, "marginal").otherwise("not_recommended")


#: dollars for a million input tokens: a table to replace with one's own
PRICES = {"basic": 0.5, "medium": 1.75, "large": 2.0, "largest": 5.0}


def cost(saved: DataFrame, prices: DataFrame) -> DataFrame:
    """(…, model, saved_usd): what saved tokens would have cost at each price (model, usd_per_million)."""
    return saved.crossJoin(F.broadcast(prices)).withColumn("saved_usd", F.round(F.greatest(F.col("tokens_saved"), F.lit(0)) * F.col("usd_per_million") / 1e6, 6))
