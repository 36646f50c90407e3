"""Writing results: JSON lines, Prometheus text, plain reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_lines(rows: DataFrame, path: str, now: int | None = None) -> None:
    """Appends rows as JSON, each with a timestamp in seconds."""
    stamped = rows if "timestamp" in rows.columns else rows.withColumn("timestamp", F.lit(now).cast("bigint") if now is not None else F.unix_timestamp())
    stamped.write.mode("append").json(path)


def cache_lines(hits: DataFrame, path: str, now: int | None = None) -> None:
    """Appends (hits, misses) with their rate."""
    n = F.col("hits") + F.col("misses")
    json_lines(hits.withColumn("hit_rate", F.when(n > 0, F.col("hits") / n).otherwise(0.0)), path, now)


def combined_lines(parts: dict[str, DataFrame], path: str, now: int | None = None) -> None:
    """Appends one row that holds one-row frames side by side, as structs by name."""
    whole: DataFrame | None = None
    for name, part in parts.items():
        one = part.select(F.struct(*part.columns).alias(name))
        whole = one if whole is None else whole.crossJoin(F.broadcast(one))  # one row each
    if whole is not None:
        json_lines(whole, path, now)


def history(operations: DataFrame, limit: int = 100) -> DataFrame:
    """The latest compressions of a log of operations."""
    kept = operations.filter(F.col("operation").isin("compress", "compress_text", "compress_context", "compress_streaming", "analyze"))
    return kept.orderBy(F.desc("timestamp")).limit(limit)


def _long(summaries: DataFrame, keys: list[str]) -> DataFrame:
    numbers = [c for c, t in summaries.dtypes if c not in keys and t in ("double", "float", "bigint", "int")]
    return summaries.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for i, c in enumerate(numbers)])).alias("m")).select(*keys, "m.*")


def prometheus(summaries: DataFrame, prefix: str = "motifloom", keys: list[str] | None = None) -> DataFrame:
    """(ord, line): the exposition format, a gauge for each number of a summary, labelled by the key columns."""
    keys = keys or []
    rows = _long(summaries, keys).filter("value is not null")
    name = F.concat(F.lit(f"{prefix}_"), F.col("metric"))
    labels: Column = F.lit("")
    if keys:
        quoted = [F.concat(F.lit(f'{k}="'), F.regexp_replace(F.coalesce(F.col(k).cast("string"), F.lit("")), r'(["\\])', r"\\$1"), F.lit('"')) for k in keys]
        labels = F.concat(F.lit("{"), F.concat_ws(",", *quoted), F.lit("}"))
    head = rows.select("ord", name.alias("name")).distinct()
    lines = head.select("ord", F.lit(0).alias("k"), F.concat(F.lit("# HELP "), "name", F.lit(" "), F.regexp_replace("name", "_", " ")).alias("line"))
    lines = lines.unionByName(head.select("ord", F.lit(1).alias("k"), F.concat(F.lit("# TYPE "), "name", F.lit(" gauge")).alias("line")))
    lines = lines.unionByName(rows.select("ord", F.lit(2).alias("k"), F.concat(name, labels, F.lit(" "), F.col("value").cast("string")).alias("line")))
    return lines.select((F.col("ord") * 3 + F.col("k")).alias("ord"), "line")


def report(summaries: DataFrame, title: str = "Quality", width: int = 28) -> DataFrame:
    """(text): each summary as lines of name and value under a title."""
    shown = [F.concat(F.rpad(F.lit(c), width, " "), F.when(F.col(c).isNull(), "-").otherwise(F.round(F.col(c), 4).cast("string") if t == "double" else F.col(c).cast("string"))) for c, t in summaries.dtypes]
    return summaries.select(F.concat_ws("\n", F.lit(title), F.lit("=" * len(title)), *shown).alias("text"))


def alert_report(raised: DataFrame) -> DataFrame:
    """(text): an alert a row, the critical ones marked twice."""
    mark = F.when(F.col("severity") == "critical", "!!").otherwise("! ")
    return raised.select(F.format_string("%s %s: %s %.4f reaches %.4f", mark, F.upper("severity"), "metric", "value", "threshold").alias("text"))


def baseline_report(bases: DataFrame, title: str = "metric") -> DataFrame:
    """(text): each baseline (metric, mean, stddev, p95, n) as lines of name and value."""
    named = F.col("metric") if "metric" in bases.columns else F.lit(title)
    shown = [F.format_string(f"  %-14s%.4f", F.lit(label), F.col(c)) for label, c in (("mean", "mean"), ("deviation", "stddev"), ("p95", "p95"))]
    return bases.select(F.concat_ws("\n", F.concat(F.lit("Baseline of "), named), F.lit("-" * 40), *shown, F.format_string("  %-14s%d", F.lit("records"), "n")).alias("text"))


def health_report(summaries: DataFrame, raised: DataFrame, bases: DataFrame | None = None, now: str = "") -> DataFrame:
    """(ord, text): state, summary, alerts and baselines, each part by itself; degraded if any alert is critical."""
    critical = raised.agg(F.coalesce(F.max((F.col("severity") == "critical").cast("int")), F.lit(0)).alias("c"))  # one row
    parts = critical.select(F.lit(0).alias("ord"), F.concat(F.lit(f"Health of coding {now}\nState: "), F.when(F.col("c") == 1, "degraded").otherwise("healthy")).alias("text"))
    parts = parts.unionByName(report(summaries).select(F.lit(1).alias("ord"), "text")).unionByName(alert_report(raised).select(F.lit(2).alias("ord"), "text"))
    return parts if bases is None else parts.unionByName(baseline_report(bases).select(F.lit(3).alias("ord"), "text"))


def histogram_report(cells: DataFrame, width: int = 40) -> DataFrame:
    """(bin, text): a bar for each bin of a histogram, the longest ``width`` wide."""
    most = cells.agg(F.max("n").alias("most"))  # one row
    bar = F.repeat(F.lit("#"), F.ceil(F.col("n") * width / F.col("most")).cast("int"))
    return cells.crossJoin(F.broadcast(most)).select("bin", F.concat_ws(" ", F.lpad(F.format_number("low", 4), 12, " "), F.rpad(bar, width, " "), F.col("n").cast("string")).alias("text"))


def embedding_metrics(found: DataFrame, path: str, now: int | None = None) -> None:
    """Appends what an offline analysis counted."""
    json_lines(found, path, now)
