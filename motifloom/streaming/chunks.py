"""Coding sequences that arrive piece by piece, in chunks of bounded size."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from motifloom.config import Config
from motifloom.functions.tokens import tokens
from motifloom.operators import codec
from motifloom.operators.codec import Coded


class Chunker:
    """Codes each ``size`` tokens; a chunk begins with the last ``overlap`` of the one before."""

    def __init__(self, size: int = 8192, overlap: int = 0, config: Config = Config()) -> None:
        if size < 100:
            raise ValueError("a chunk has 100 tokens at least")
        if not 0 <= overlap < size:
            raise ValueError("the overlap must be shorter than a chunk")
        # memory is bounded by the chunk, so deep passes aren't worth their time
        self.size, self.overlap, self.config = size, overlap, config.but(passes=min(2, config.passes))
        self.buffer: list = []
        self.index = 0
        self.open = True
        self.tokens_in = self.tokens_out = 0

    def add(self, more: Sequence) -> Iterator[Coded]:
        """The chunks that these tokens complete."""
        if not self.open:
            raise RuntimeError("the stream has ended")
        self.buffer += more
        while len(self.buffer) >= self.size:
            yield self._coded(self.buffer[: self.size])
            self.buffer = self.buffer[self.size - self.overlap :]

    def flush(self) -> Iterator[Coded]:
        """What is left, and the end."""
        if not self.open:
            raise RuntimeError("the stream has ended")
        self.open = False
        if len(self.buffer) > (self.overlap if self.index else 0):
            yield self._coded(self.buffer)
        self.buffer = []

    def reset(self) -> None:
        self.buffer, self.index, self.open, self.tokens_in, self.tokens_out = [], 0, True, 0, 0

    def _coded(self, part: list) -> Coded:
        out = codec.encode(part, self.config)
        self.index += 1
        self.tokens_in += len(part) - (self.overlap if self.index > 1 else 0)
        self.tokens_out += len(out.stream)
        return out

    @property
    def ratio(self) -> float:
        return self.tokens_out / self.tokens_in if self.tokens_in else 1.0


def joined(streams: Sequence[Sequence], overlap: int = 0, config: Config = Config()) -> list:
    """The sequence that coded chunks stand for."""
    return [t for i, s in enumerate(streams) for t in codec.decode(s, config)[overlap if i else 0 :]]


def chunked(docs: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """(doc_id, chunk, n_tokens, text): documents in chunks, by place alone; no shuffle."""
    step = size - overlap
    w = F.col("w")
    starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.size(w) - overlap - 1, F.lit(0)), F.lit(step)))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), tokens(F.col("text")).alias("w")).select("doc_id", "w", F.posexplode(starts).alias("chunk", "s"))
    part = F.slice(w, F.col("s") + 1, size)
    return rows.select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), F.size(part).cast("bigint").alias("n_tokens"), F.array_join(part, " ").alias("text"))


def reassembled(chunks: DataFrame, overlap: int = 0) -> DataFrame:
    """(doc_id, text): chunks put together again."""
    own = F.when(F.col("chunk") > 0, F.slice(F.split("text", " "), overlap + 1, 2**31 - 2 - overlap)).otherwise(F.split("text", " "))
    parts = chunks.select("doc_id", "chunk", F.array_join(own, " ").alias("part")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "part"))).alias("p"))
    return parts.select("doc_id", F.array_join(F.transform("p", lambda x: x["part"]), " ").alias("text"))


def coded_stream(pieces: DataFrame, size: int = 8192, overlap: int = 0, config: Config = Config(), end: str = "last") -> DataFrame:
    """(stream_id, chunk, n_tokens, n_coded, coded) of a stream of (stream_id, seq, text, last).

    The tokens of a chunk not yet full are the state of its stream; ``last``
    marks the piece that ends one.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = Chunker(size, overlap, config)
        if state.exists:
            raw, own.index = state.get
            own.buffer = json.loads(raw)
        rows = pd.concat(list(batches)).sort_values("seq")
        for text, last in zip(rows["text"], rows[end]):
            first = own.index
            made = list(own.add((text or "").split()))
            if last:
                made += own.flush()
                own.reset()
            for i, c in enumerate(made):
                yield pd.DataFrame({"stream_id": [key[0]], "chunk": [first + i], "n_tokens": [len(c.original)], "n_coded": [len(c.stream)], "coded": [" ".join(c.stream)]})
        if own.buffer or own.index:
            state.update((json.dumps(own.buffer), own.index))
        elif state.exists:
            state.remove()

    return pieces.groupBy("stream_id").applyInPandasWithState(step, "stream_id bigint, chunk bigint, n_tokens bigint, n_coded bigint, coded string", "buffer string, chunk bigint", "append", GroupStateTimeout.NoTimeout)
