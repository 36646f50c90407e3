"""Alerts that are kept apart by a cooldown and handed to subscribers."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.sources.storage import settled

from . import quality

Rule = tuple[str, float, float]  #: metric, warning, critical
log = logging.getLogger(__name__)


def rules_from(settings: Mapping[str, float]) -> list[Rule]:
    """Rules from settings ``<metric>_warning`` and ``<metric>_critical``, on the means of the three metrics watched."""
    out = []
    for metric in ("compression_ratio", "degradation", "overhead"):
        if f"{metric}_warning" in settings and f"{metric}_critical" in settings:
            out.append((f"{metric}_mean", float(settings[f"{metric}_warning"]), float(settings[f"{metric}_critical"])))
    return out


class Manager:
    """Checks summaries against rules; after an alert, the same metric (of the same keys) is silent for ``cooldown`` seconds."""

    def __init__(self, rules: list[Rule] | None = None, cooldown: float = 300.0, keys: list[str] | None = None) -> None:
        self.rules, self.cooldown, self.keys = list(quality.RULES if rules is None else rules), cooldown, list(keys or [])
        self.subscribers: list[Callable[[DataFrame], None]] = []
        self.last: DataFrame | None = None

    def add_rule(self, metric: str, warning: float, critical: float) -> None:
        self.rules.append((metric, warning, critical))

    def remove_rule(self, metric: str) -> None:
        """Without the rules of a metric."""
        self.rules = [r for r in self.rules if r[0] != metric]

    def subscribe(self, callback: Callable[[DataFrame], None]) -> None:
        self.subscribers.append(callback)

    def unsubscribe(self, callback: Callable[[DataFrame], None]) -> None:
        self.subscribers = [s for s in self.subscribers if s != callback]

    def clear(self) -> None:
        """Forget all cooldowns."""
        self.last = None

    def check(self, summaries: DataFrame, now: float | None = None) -> DataFrame:
        """The alerts that summaries raise and no cooldown silences; a subscriber that fails stops no other."""
        now = time.time() if now is None else now
        names = [*self.keys, "metric"]
        raised = quality.alerts(summaries, [r for r in self.rules if r[0] in summaries.columns], keys=self.keys) if any(r[0] in summaries.columns for r in self.rules) else None
        if raised is None:
            return quality.alerts(summaries.limit(0).withColumn("none", F.lit(0.0)), [("none", 1.0, 1.0)], keys=self.keys)
        if self.last is not None:
            same = [raised[n].eqNullSafe(self.last[n]) for n in names]
            quiet = self.last.filter(F.lit(now) - F.col("at") < self.cooldown)
            raised = raised.join(quiet, [raised[n].eqNullSafe(quiet[n]) for n in names], "left_anti") if same else raised
        raised = settled(raised)
        fresh = raised.select(*names, F.lit(now).alias("at"))
        held = fresh if self.last is None else self.last.filter(F.lit(now) - F.col("at") < self.cooldown).unionByName(fresh)
        self.last = settled(held.groupBy(*names).agg(F.max("at").alias("at")))
        for call in self.subscribers:
            try:
                call(raised)
            except Exception:  # noqa: BLE001
                log.warning("a subscriber failed", exc_info=True)
        return raised
