"""Tokenisers: white space as column expressions, others over Arrow batches."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.functions.tokens import tokens


class Tokenizer(Protocol):
    """What every tokeniser can do."""

    def encode(self, text: str) -> list: ...
    def decode(self, ids: list) -> str: ...
    def size(self) -> int: ...
    def is_special(self, token: object) -> bool: ...


class Whitespace:
    """Runs between white space."""

    def encode(self, text: str) -> list[str]:
        return text.split()

    def decode(self, ids: list[str]) -> str:
        return " ".join(ids)

    def size(self) -> int:
        return 0

    def is_special(self, token: object) -> bool:
        return False


class BytePair:
    """A byte-pair vocabulary from a file of base 64 and rank."""

    def __init__(self, path: str, pattern: str = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+") -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self.own.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        return self.own.decode(ids)

    def size(self) -> int:
        return self.own.n_vocab

    def is_special(self, token: object) -> bool:
        return False


class Pieces:
    """A SentencePiece model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, text: str) -> list[int]:
        return self.own.encode(text)

    def decode(self, ids: list[int]) -> str:
        return self.own.decode(ids)

    def size(self) -> int:
        return self.own.get_piece_size()

    def is_special(self, token: object) -> bool:
        return self.own.is_control(token) or self.own.is_unknown(token)


class Fast:
    """A tokenizer.json of the tokenizers library."""

    def __init__(self, path: str) -> None:
        import tokenizers

        self.own = tokenizers.Tokenizer.from_file(path)

    def encode(self, text: str) -> list[int]:
        return self.own.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        return self.own.decode(ids)

    def size(self) -> int:
        return self.own.get_vocab_size()

    def is_special(self, token: object) -> bool:
        return any(t.special and i == token for i, t in self.own.get_added_tokens_decoder().items())

    def add_tokens(self, more: list[str]) -> int:
        return self.own.add_tokens(more)


def tokenized(docs: DataFrame, make: Callable[[], Tokenizer] | None = None, text: str = "text", out: str = "tokens") -> DataFrame:
    """``docs`` with a column of tokens; ``make`` builds the tokeniser once a Python worker."""
    if make is None:
        return docs.withColumn(out, tokens(F.col(text)))

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = make()
        for batch in batches:
            yield batch.map(lambda t: [str(x) for x in own.encode(t or "")])

    return docs.withColumn(out, split(text))
