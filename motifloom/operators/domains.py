"""What kind of text a token sequence is, by the words that give it away."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifloom.functions.tokens import tokens as split_tokens

PYTHON = tuple("class def elif else for if import return self".split())
JSON = tuple("[ ] { } , :".split())
POLICY = tuple("action allow deny effect policy resource rule user".split())


def detected(tokens: Sequence) -> tuple[str | None, float]:
    """(domain, confidence); (None, 0) for sequences that aren't all text or fit none."""
    if not tokens or not all(isinstance(t, str) for t in tokens):
        return None, 0.0
    low = [t.lower() for t in tokens]
    n = len(low)
    hits = [sum(t in kind for t in low) for kind in (PYTHON, JSON, POLICY)]
    score = [(hits[0] + 0.2 * sum(":" in t for t in low)) / n, hits[1] / n, hits[2] / n]
    rules = [("code-python", 0, 2, 0.08, 0.25), ("json", 1, 4, 0.12, 0.2), ("security-policy", 2, 3, 0.1, 0.2)]
    return next(((name, min(1.0, score[k] + more)) for name, k, least, share, more in rules if hits[k] >= least and score[k] >= share), (None, 0.0))


def _among(words: Column, kind: tuple[str, ...]) -> Column:
    return F.size(F.filter(words, lambda t: t.isin(*kind)))


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, python_hits, json_hits, policy_hits, domain, confidence) of each document; one pass, no shuffle."""
    low = F.transform(split_tokens(F.col(text)), lambda t: F.lower(t))
    rows = docs.select("doc_id", low.alias("w")).select(
        "doc_id",
        F.size("w").alias("n"),
        _among(F.col("w"), PYTHON).cast("bigint").alias("python_hits"),
        _among(F.col("w"), JSON).cast("bigint").alias("json_hits"),
        _among(F.col("w"), POLICY).cast("bigint").alias("policy_hits"),
        F.size(F.filter("w", lambda t: t.contains(":"))).alias("colons"),
    )
    n = F.greatest(F.col("n"), F.lit(1))
    python, json_, policy = (F.col("python_hits") + F.col("colons") * 0.2) / n, F.col("json_hits") / n, F.col("policy_hits") / n
    is_python, is_json, is_policy = (F.col("python_hits") >= 2) & (python >= 0.08), (F.col("json_hits") >= 4) & (json_ >= 0.12), (F.col("policy_hits") >= 3) & (policy >= 0.1)
    pick = lambda a, b, c, d: F.when(is_python, a).when(is_json, b).when(is_policy, c).otherwise(d)
    domain = pick(F.lit("code-python"), F.lit("json"), F.lit("security-policy"), F.lit(None).cast("string"))
    confidence = pick(F.least(python + 0.25, F.lit(1.0)), F.least(json_ + 0.2, F.lit(1.0)), F.least(policy + 0.2, F.lit(1.0)), F.lit(0.0))
    return rows.select("doc_id", "python_hits", "json_hits", "policy_hits", domain.alias("domain"), F.round(confidence, 6).alias("confidence"))
