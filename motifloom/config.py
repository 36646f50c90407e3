"""Settings of a compression, and the rules they must keep."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace
from typing import Any

SELECTIONS = ("greedy", "optimal", "beam", "ilp", "semantic")
DISCOVERIES = ("suffix-array", "window", "sliding-window", "bpe", "bpe-extended")


@dataclass(frozen=True)
class Config:
    """What to look for, how to choose, and how the output is spelled."""

    min_length: int = 2
    max_length: int = 8
    discovery: str = "window"
    selection: str = "greedy"
    beam_width: int = 8
    ilp_patterns: int = 12  #: so many patterns are searched exactly; with more, by local improvement
    passes: int = 3
    hierarchical: bool = True
    least_gain: float = 0.02  #: share of the body a further pass must save
    gain_over_cost: float = 1.5  #: body tokens saved a dictionary token, likewise
    discard_poor_pass: bool = False  #: a further pass that saves too little is undone, not just the last
    length_tokens: bool = True
    pool: int = 500
    fuzzy: bool = False
    max_diff: int = 1
    templates: bool = False  #: code by templates where that is shorter
    template_instances: int = 3
    template_slots: int = 3
    slot_length: int = 10
    frame_ratio: float = 0.6
    prune_subsumed: bool = True
    independent: int = 2
    regions: bool = False
    importance: bool = False
    importance_threshold: float = 0.9
    importance_weight: float = 0.5
    context: int = 8
    similarity: float = 0.7
    diversity_penalty: float = 0.5
    static_id: str | None = None
    static_auto: bool = False
    static_confidence: float = 0.85
    meta: tuple[str, str] = ("<MT_", ">")
    dictionary: tuple[str, str] = ("<Dict>", "</Dict>")
    length_mark: tuple[str, str] = ("<Len:", ">")
    patch: tuple[str, str] = ("<Patch>", "</Patch>")
    index_mark: tuple[str, str] = ("<Idx:", ">")
    static_mark: tuple[str, str] = ("<StaticDict:", ">")
    slot: str = "<Slot>"
    slot_value: tuple[str, str] = ("<SlotVal>", "</SlotVal>")
    verify: bool = True

    @property
    def extra(self) -> int:
        """Tokens of a dictionary entry besides its name and its sequence."""
        return int(self.length_tokens)

    def but(self, **changes: Any) -> Config:
        """The same with some settings changed."""
        return replace(self, **changes)


def validate(config: Config) -> Config:
    """``config``, if it keeps the rules; otherwise a ValueError says which it breaks."""
    rules = {
        "min_length must be at least 2": config.min_length >= 2,
        "max_length must not be below min_length": config.max_length >= config.min_length,
        "pool must be positive": config.pool > 0,
        "passes must be at least 1": config.passes >= 1,
        f"selection must be one of {SELECTIONS}": config.selection in SELECTIONS,
        f"discovery must be one of {DISCOVERIES}": config.discovery in DISCOVERIES,
        "beam_width must be at least 1": config.beam_width >= 1,
        "max_diff must not be negative": config.max_diff >= 0,
        "static_confidence must be between 0 and 1": 0 <= config.static_confidence <= 1,
        "frame_ratio must be between 0 and 1": 0 <= config.frame_ratio <= 1,
        "independent must be at least 1": config.independent >= 1,
    }
    broken = [said for said, kept in rules.items() if not kept]
    if broken:
        raise ValueError("; ".join(broken))
    if config.max_length > 16:
        warnings.warn("max_length above 16 costs much and finds little", stacklevel=2)
    return config
