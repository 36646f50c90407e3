"""How much a pattern matters for meaning: important ones are compressed last."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import Candidate, Token
from .select import mean_cosine

DECAY = 2.0
WEIGHTS = {"positional": 0.4, "frequency": 0.3, "length": 0.3}
WEIGHTS_WITH_VECTORS = {"embedding": 0.4, "positional": 0.3, "frequency": 0.2, "length": 0.1}


def positional(tokens: Sequence[Token], candidates: Sequence[Candidate]) -> list[float]:
    """Patterns whose mean place is early matter more."""
    n = len(tokens)
    return [math.exp(-DECAY * (sum(c.starts) / len(c.starts)) / n) if c.starts and n else 0.5 for c in candidates]


def positional_each(tokens: Sequence[Token], candidates: Sequence[Candidate]) -> list[float]:
    """Likewise, as the mean over the places."""
    n = len(tokens)
    return [sum(math.exp(-DECAY * s / n) for s in c.starts) / len(c.starts) if c.starts and n else 0.5 for c in candidates]


def frequency(tokens: Sequence[Token], candidates: Sequence[Candidate]) -> list[float]:
    """The rarer, the more it matters."""
    most = max((len(c.starts) for c in candidates), default=0)
    return [1 - len(c.starts) / most if most else 0.5 for c in candidates]


def length(tokens: Sequence[Token], candidates: Sequence[Candidate]) -> list[float]:
    """The longer, the more it matters."""
    most = max((c.length for c in candidates), default=0)
    return [c.length / most if most else 0.5 for c in candidates]


def embedding(tokens: Sequence[Token], candidates: Sequence[Candidate], embed: Callable, reach: int = 5, sample: int = 10) -> list[float]:
    """The more its surroundings differ, the more it matters; scaled to 0..1 over the candidates."""
    raw: list[float | None] = []
    for c in candidates:
        around = [" ".join(map(str, tokens[max(0, s - reach) : s + c.length + reach])) for s in c.starts[:sample]]
        raw.append(1 - mean_cosine(embed(around)) if len(around) > 1 else None)
    known = [r for r in raw if r is not None]
    if not known or max(known) == min(known):
        return [0.5] * len(raw)
    low, high = min(known), max(known)
    return [0.5 if r is None else (r - low) / (high - low) for r in raw]


def composite(tokens: Sequence[Token], candidates: Sequence[Candidate], embed: Callable | None = None) -> list[float]:
    """Weighted mean of the scores; one that fails is left out."""
    ways: dict[str, Callable[[], list[float]]] = {"positional": lambda: positional(tokens, candidates), "frequency": lambda: frequency(tokens, candidates), "length": lambda: length(tokens, candidates)}
    if embed is not None:
        ways["embedding"] = lambda: embedding(tokens, candidates, embed)
    weights = WEIGHTS_WITH_VECTORS if embed is not None else WEIGHTS
    total, out = 0.0, [0.0] * len(candidates)
    for name, weight in weights.items():
        try:
            scores = ways[name]()
        except (RuntimeError, ValueError, OSError):
            continue
        total += weight
        out = [o + weight * s for o, s in zip(out, scores)]
    return [o / total for o in out] if total else [0.5] * len(candidates)


def prioritised(candidates: Sequence[Candidate], scores: Sequence[float], weight: float = 1.0) -> list[Candidate]:
    """Priorities raised for what matters little; unchanged if there isn't a score for each."""
    if len(candidates) != len(scores):
        return list(candidates)
    return [Candidate(c.tokens, c.starts, c.priority + int((1 - s) * 5 * weight), c.patches) for c, s in zip(candidates, scores)]


def unimportant(candidates: Sequence[Candidate], scores: Sequence[float], threshold: float = 0.8) -> list[Candidate]:
    """Those that score below the threshold."""
    return [c for c, s in zip(candidates, scores) if s < threshold]


def positional_column(mean_start: Column, n: Column) -> Column:
    return F.when(n > 0, F.exp(-DECAY * mean_start / n)).otherwise(0.5)


def composite_column(position: Column, rarity: Column, size: Column) -> Column:
    return position * WEIGHTS["positional"] + rarity * WEIGHTS["frequency"] + size * WEIGHTS["length"]


def boost_column(score: Column, weight: float = 1.0) -> Column:
    return F.floor((1 - score) * 5 * weight).cast("bigint")
