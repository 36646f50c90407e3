"""Discovery as a table function: plug-in stages for SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from motifloom.config import Config, validate

from . import patterns as pt
from .patterns import Candidate

Find = Callable[[list[str], Config], list[Candidate]]
#: stages that come with the engine
STAGES: dict[str, Find] = {"exact": pt.ngrams, "suffix-array": pt.by_suffixes, "bpe": pt.merged_pairs, "bpe-extended": pt.grown_pairs, "fuzzy": pt.fuzzy}


def register(spark: SparkSession, name: str = "discover", stages: dict[str, Find] | None = None, config: Config = Config()) -> None:
    """Makes ``name(text)`` known to SQL: (stage, pattern, length, n, starts, priority) of each stage in turn.

    ``stages`` may hold any function from tokens and settings to candidates; a
    null text has none.  Used as ``FROM docs, LATERAL name(docs.text)``.
    """
    own, settings = dict(STAGES if stages is None else stages), validate(config)

    class Discover:
        def eval(self, text: str | None) -> Iterator[tuple]:
            words = (text or "").split()
            for stage, find in own.items():
                for c in find(words, settings) if words else ():
                    yield stage, " ".join(map(str, c.tokens)), c.length, len(c.starts), list(c.starts), c.priority

    spark.udtf.register(name, udtf(Discover, returnType="stage string, pattern string, length bigint, n bigint, starts array<int>, priority int"))
