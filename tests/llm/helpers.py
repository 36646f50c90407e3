"""Plain-Python counterparts for the tests of this folder."""

import random
import re

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def split(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def words(rng, n, size=3000):
    return [f"{rng.choice('bdfgklmnprst')}{'aeiou'[i % 5]}{i}" for i in (rng.randrange(size) for _ in range(n))]


def text(rng, n, size=3000):
    return " ".join(words(rng, n, size))


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows], DOCS)


def odd(spark, more=()):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    same = text(rng, 90)
    rows = [(1, None, None, None, None), (None, same, "en", "a", 5), (2, "", "en", "a", 0), (3, "  \n", "en", None, 3), (4, same, "en", "a", 9), (4, same, "en", "a", 9), (5, same, "en", "b", 9)]
    rows += [(6, "x" * 200_000, "en", "a", 200_000), (7, text(rng, 60_000, 50_000), "en", "b", 1), (8, "é ß 漢字 \x00 ok", "fr", "b", 12), (9, "!!! ???", "en", "b", 7), *more]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """The same rows with more columns, named like those of the operators' results and plans."""
    from pyspark.sql import functions as F

    names = ("score", "probability", "position", "epoch", "kept_id", "node", "a", "b", "root", "n", "item_id", "kind", "start", "_n", "_key", "_id", "_source", "_range", "_row", "_gone", "s", "u", "v")
    return df.withColumns({c: F.lit(c) for c in names if c not in df.columns})
