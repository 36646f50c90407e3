"""Reading corpora of documents: JSON lines, directories, databases, streams."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("id", "text", "domain", "source", "language", "created_at")],
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("token_count", T.IntegerType()),
        *[T.StructField(c, T.StringType()) for c in ("parent_id", "path")],
    ]
)
QUESTIONS = "id string, context_id string, question string, answer string, answer_type string"
REQUIRED = ("id", "text", "domain")


def _checked(rows: DataFrame, strict: bool) -> DataFrame:
    """Rows that have all required fields; with ``strict`` one that lacks any fails the query."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]))
    if not strict:
        return rows.filter(F.size(missing) == 0)
    return rows.withColumn("id", F.when(F.size(missing) == 0, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("a document lacks "), F.array_join(missing, ", "))).cast("string")))


def _with_tags(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def json_lines(spark: SparkSession, *paths: str, strict: bool = True) -> DataFrame:
    """Documents of files with one JSON object a line; blank lines are skipped, nothing is inferred."""
    return _with_tags(_checked(spark.read.schema(SCHEMA).json(list(paths)), strict))


def directory(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Documents of the files that ``manifest.json`` names, or of all ``*.jsonl`` below a directory."""
    manifest = Path(path) / "manifest.json"
    if manifest.exists():
        domains = json.loads(manifest.read_text()).get("domains", {})
        listed = [str(Path(path) / leaf["path"]) for group in domains.values() for leaf in group.values() if "path" in leaf]
        return json_lines(spark, *listed, strict=strict)
    found = spark.read.schema(SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(path)
    return _with_tags(_checked(found, strict))


def from_json_column(rows: DataFrame, column: str, strict: bool = True) -> DataFrame:
    """Documents held as JSON text in a column, as databases keep them."""
    return _with_tags(_checked(rows.select(F.from_json(column, SCHEMA).alias("d")).select("d.*"), strict))


def database(spark: SparkSession, url: str, query: str, properties: dict[str, str] | None = None, strict: bool = True, **partitioning: str) -> DataFrame:
    """Documents of a JDBC query whose first column is JSON, or which has their fields as columns.

    ``partitioning`` are the reader's own options (partitionColumn and so on).
    """
    reader = spark.read.format("jdbc").option("url", url)
    # a query can't be read in parallel, a subquery in the place of a table can
    reader = reader.option("dbtable", f"({query}) documents") if partitioning else reader.option("query", query)
    rows = reader.options(**(properties or {}), **partitioning).load()
    if {"id", "text"} <= set(rows.columns):
        fields = [F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMA]
        return _with_tags(_checked(rows.select(*fields), strict))
    return from_json_column(rows, rows.columns[0], strict)


def stream(spark: SparkSession, path: str, schema: str | T.StructType, **options: str) -> DataFrame:
    """A stream of the parquet files that arrive in a directory."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions with the document that answers each."""
    return spark.read.schema(QUESTIONS).json(path)
