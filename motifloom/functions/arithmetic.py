"""What a replacement costs and saves: for Python numbers and for columns alike."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def raw_savings(length: int, count: int, extra: int = 1) -> int:
    """Tokens saved if ``count`` stretches of ``length`` become one token each; negative if it doesn't pay."""
    return length * count - (1 + length + count + extra)


def savings(length: int, count: int, extra: int = 1) -> int:
    """``raw_savings``, 0 at least."""
    return max(0, raw_savings(length, count, extra))


def pays(length: int, count: int, extra: int = 1) -> bool:
    """Whether anything is saved at all."""
    return length > 1 and count > 0 and raw_savings(length, count, extra) > 0


def least_count(length: int, extra: int = 1) -> float:
    """The smallest count that pays; infinite for single tokens."""
    return math.ceil((2 + length + extra) / (length - 1)) if length > 1 else math.inf


def marginal(length: int, count: int, extra: int = 1) -> int:
    """What one more stretch adds."""
    return savings(length, count + 1, extra) - savings(length, count, extra)


def density(length: int, priority: int = 0) -> float:
    """Saved share of a stretch, plus a tenth of its priority."""
    return (length - 1) / length + 0.1 * priority


def raw_savings_column(length: Column, count: Column, extra: int = 1) -> Column:
    return (length * count - (F.lit(1 + extra) + length + count)).cast("bigint")


def savings_column(length: Column, count: Column, extra: int = 1) -> Column:
    return F.greatest(raw_savings_column(length, count, extra), F.lit(0).cast("bigint"))


def pays_column(length: Column, count: Column, extra: int = 1) -> Column:
    return (length > 1) & (count > 0) & (raw_savings_column(length, count, extra) > 0)


def least_count_column(length: Column, extra: int = 1) -> Column:
    return F.when(length > 1, F.ceil((length + F.lit(2 + extra)) / (length - 1))).cast("bigint")


def marginal_column(length: Column, count: Column, extra: int = 1) -> Column:
    return savings_column(length, count + 1, extra) - savings_column(length, count, extra)


def density_column(length: Column, priority: Column) -> Column:
    return (length - 1) / length + priority * 0.1
