"""Regions of a prompt (system, user, code and so on), and what they mean for patterns."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .patterns import Candidate, Token

#: by kind: the largest ratio aimed at, and what it adds to priorities
SETTINGS = {"system": (0.95, -2), "user": (0.85, 0), "assistant": (0.8, 1), "context": (0.5, 3), "code": (0.75, 1), "data": (0.4, 4), "unknown": (0.8, 0)}
_KINDS = {"system": "[SYSTEM] [/SYSTEM] <<SYS>> <</SYS>>", "user": "[INST] [/INST] [USER]", "assistant": "[ASSISTANT]", "context": "[CONTEXT] [/CONTEXT]"}
#: by kind: the longest pattern and the least count that another profile allows
LIMITS = {"system": (4, 5), "user": (6, 3), "context": (10, 2), "code": (6, 3)}
MARKERS = {m: kind for kind, listed in _KINDS.items() for m in listed.split()}
FENCE = "```"
CLOSED_FROM = 0.98  #: regions of this ratio or more are left as they are


class Region(NamedTuple):
    start: int
    end: int
    kind: str

    @property
    def ratio(self) -> float:
        return SETTINGS.get(self.kind, SETTINGS["unknown"])[0]

    @property
    def boost(self) -> int:
        return SETTINGS.get(self.kind, SETTINGS["unknown"])[1]


def regions_of(tokens: Sequence[Token], markers: Mapping[str, str] = MARKERS, default: str = "unknown") -> list[Region]:
    """Regions that cover the sequence: each marker begins one, fences enclose code, a lone brace begins data."""
    cuts: list[tuple[int, str]] = [(0, default)]
    fenced = False
    for i, token in enumerate(tokens):
        t = str(token)
        if FENCE in t:
            cuts.append((i + 1, default) if fenced else (i, "code"))
            fenced = not fenced
        elif not fenced:
            if t.strip() == "{":
                cuts.append((i, "data"))
            elif kind := next((k for m, k in markers.items() if m in t), None):
                cuts.append((i, kind))
    out: list[Region] = []
    for (a, kind), b in zip(cuts, [*[c[0] for c in cuts[1:]], len(tokens)]):
        if a >= b:
            continue
        if out and out[-1].kind == kind:
            out[-1] = Region(out[-1].start, b, kind)
        else:
            out.append(Region(a, b, kind))
    return out


def by_share(tokens: Sequence[Token], system: float = 0.1) -> list[Region]:
    """Without markers: the first share is the system's, the rest the user's."""
    n, cut = len(tokens), int(len(tokens) * system)
    return [r for r in (Region(0, cut, "system"), Region(cut, n, "user")) if r.start < r.end]


def by_region(candidates: Sequence[Candidate], regions: Sequence[Region]) -> list[Candidate]:
    """Candidates without the starts in closed regions, their priority raised by the mean boost of the others (rounded down)."""
    if not regions:
        return list(candidates)
    begins, out = [r.start for r in regions], []
    for c in candidates:
        own = [(s, regions[max(0, bisect_right(begins, s) - 1)]) for s in c.starts]
        own = [(s, r) for s, r in own if not (r.start <= s < r.end and r.ratio >= CLOSED_FROM)]
        if own:
            boost = sum(r.boost if r.start <= s < r.end else 0 for s, r in own) // len(own)
            out.append(Candidate(c.tokens, tuple(s for s, _ in own), c.priority + boost, c.patches))
    return out


def limits(kind: str) -> tuple[int, int]:
    """Longest pattern and least count in a region of this kind."""
    return LIMITS.get(kind, (8, 3))


def totals(regions: Sequence[Region]) -> dict[str, int]:
    """Tokens by kind."""
    out: dict[str, int] = {}
    for r in regions:
        out[r.kind] = out.get(r.kind, 0) + r.end - r.start
    return out


def of_turns(turns: DataFrame, n_tokens: str = "n_tokens") -> DataFrame:
    """(conv_id, region, kind, start, end): runs of turns of one role, with their token ranges.

    Gaps and islands over the turns of each conversation; one shuffle by
    conversation serves all three windows.
    """
    by = Window.partitionBy("conv_id").orderBy("turn")
    kind = F.when(F.col("role").isin(*SETTINGS), F.col("role")).otherwise("unknown")
    end = F.sum(n_tokens).over(by)
    rows = turns.withColumn("kind", kind).withColumn("end", end).withColumn("start", F.col("end") - F.col(n_tokens))
    fresh = F.when(F.lag("kind").over(by) == F.col("kind"), 0).otherwise(1)
    islands = rows.withColumn("fresh", fresh).withColumn("region", F.sum("fresh").over(by))
    return islands.groupBy("conv_id", "region", "kind").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def located(points: DataFrame, regions: DataFrame, key: str, at: str) -> DataFrame:
    """``points`` with the kind of the region that holds each: an as-of join by one window, without comparing pairs."""
    spans = regions.select(key, F.col("start").alias("_at"), F.lit(0).alias("_o"), F.struct("kind", "end").alias("_r"), *[F.lit(None).cast(t).alias(c) for c, t in points.dtypes if c != key])
    both = spans.unionByName(points.select("*", F.col(at).alias("_at"), F.lit(1).alias("_o"), F.lit(None).cast("struct<kind:string,end:bigint>").alias("_r")), allowMissingColumns=True)
    by = Window.partitionBy(key).orderBy("_at", "_o").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_r", F.last("_r", ignorenulls=True).over(by)).filter("_o = 1")
    return found.select(*points.columns, F.when(F.col(at) < F.col("_r.end"), F.col("_r.kind")).alias("kind"))
