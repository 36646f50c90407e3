"""Tokens as columns: splitting, reserved spellings, lengths and indices in brackets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from motifloom.config import Config

SPACE = r"[ \t\n\x0B\f\r]+"


def tokens(text: Column) -> Column:
    """The runs between white space; none for a null or blank text."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def token_count(text: Column) -> Column:
    """How many tokens ``text`` has, without building them."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("bigint")


def normal_text(text: Column) -> Column:
    """The tokens with one space between."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def whole_numbers(tokens: Column) -> Column:
    """Token ids as an array of whole numbers from 0 up; null where any of them is none."""
    ids = F.transform(tokens, lambda t: t.try_cast("bigint"))
    good = F.forall(F.zip_with(tokens, ids, lambda t, i: i.isNotNull() & (i >= 0) & (i.cast("double") == t.try_cast("double"))), lambda x: x)
    return F.when(good, ids)


def is_meta(token: Column, config: Config = Config()) -> Column:
    """Whether a token is spelled like the name of a dictionary entry."""
    return token.startswith(config.meta[0]) & token.endswith(config.meta[1])


def reserved_pattern(config: Config = Config()) -> str:
    """A regular expression that whole reserved tokens match."""
    fixed = [*config.dictionary, *config.patch, config.slot, *config.slot_value]
    spans = [config.meta, config.index_mark, config.static_mark, ("<SD_", ">")]
    if config.length_tokens:
        spans.append(config.length_mark)
    return "^(?:" + "|".join([re.escape(f) for f in fixed] + [f"{re.escape(a)}.*{re.escape(b)}" for a, b in spans]) + ")$"


def has_reserved(words: Column, config: Config = Config()) -> Column:
    """Whether any of the tokens is reserved, so that the sequence can't be coded as it is."""
    return F.exists(words, lambda t: t.rlike(reserved_pattern(config)))


def bracketed(number: Column, mark: tuple[str, str]) -> Column:
    """``<Len:3>`` and the like."""
    return F.concat(F.lit(mark[0]), number.cast("string"), F.lit(mark[1]))


def bracketed_number(token: Column, mark: tuple[str, str]) -> Column:
    """The number in ``<Len:3>`` and the like; null where the token is none."""
    inner = F.regexp_extract(token, f"^{re.escape(mark[0])}([0-9]+){re.escape(mark[1])}$", 1)
    return F.when(inner != "", inner.cast("bigint"))


def is_compressed(words: Column, config: Config = Config()) -> Column:
    """Whether a stream has a dictionary."""
    return F.array_contains(words, config.dictionary[0])


def body_of(words: Column, config: Config = Config()) -> Column:
    """What follows the dictionary; all of it where there is none."""
    at = F.array_position(words, config.dictionary[1])
    return F.when(at > 0, F.slice(words, (at + 1).cast("int"), F.greatest(F.size(words) - at.cast("int"), F.lit(0)))).otherwise(words)


def context(words: Column, start: Column, length: Column, reach: int) -> Column:
    """The tokens around a stretch (``start`` from 0), ``reach`` on either side."""
    first = F.greatest(start - reach, F.lit(0))
    return F.slice(words, (first + 1).cast("int"), (start + length + reach - first).cast("int"))


def free_starts(starts: Column, length: Column) -> Column:
    """Of ascending starts, those taken from left to right without overlap."""
    step = F.aggregate(
        starts,
        F.struct(F.array().cast("array<int>").alias("kept"), F.lit(-1).alias("next")),
        lambda a, p: F.when(p >= a["next"], F.struct(F.concat(a["kept"], F.array(p)).alias("kept"), (p + length).cast("int").alias("next"))).otherwise(a),
    )
    return step["kept"]


def free_count(starts: Column, length: Column) -> Column:
    """How many :func:`free_starts` takes."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).alias("next")),
        lambda a, p: F.when(p >= a["next"], F.struct((a["n"] + 1).alias("n"), (p + length).cast("int").alias("next"))).otherwise(a),
        lambda a: a["n"],
    )
