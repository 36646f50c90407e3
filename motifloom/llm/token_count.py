"""Token counts by a linear longest-match automaton.

The greedy word-piece segmentation of a word takes, again and again, the
longest vocabulary entry that begins the rest.  Here the vocabulary is a trie
with failure links; each node also has the number of pieces that following its
failure link pops.  One pass over a word's bytes then gives the number of
pieces in linear time, without building one of them or ever stepping back.

Words are the runs between white space, each with a space before it, as the
byte-level vocabularies spell the start of a word.  A word's count does not
depend on its neighbours, so each worker remembers those of the words it met
(a cache of bounded size, emptied when full; it changes no result).

Defined results: null and empty texts have 0 words and 0 tokens; a word that
the vocabulary cannot spell counts as one piece (as an unknown token does); a
null ``doc_id`` stays null; repeated rows are counted each; other columns are
not looked at, whatever their names.
"""

from __future__ import annotations

import base64
from array import array
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE = 400_000  #: words a worker remembers


def load_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The entries of a vocabulary file: lines of base 64 and rank."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


@dataclass
class Automaton:
    """Trie edges by node * 256 + byte; failure links (-1: none) and pops by node."""

    edges: dict[int, int]
    fail: array
    pops: array

    @classmethod
    def build(cls, vocabulary: Iterable[bytes]) -> Automaton:
        edges: dict[int, int] = {}
        parent, byte, final = [-1], [0], [False]
        for piece in vocabulary:
            node = 0
            for b in piece:
                key = node << 8 | b
                if (child := edges.get(key)) is None:
                    child = edges[key] = len(parent)
                    parent.append(node)
                    byte.append(b)
                    final.append(False)
                node = child
            final[node] = node != 0
        children: dict[int, list[int]] = {}
        for child in range(1, len(parent)):
            children.setdefault(parent[child], []).append(child)
        fail, pops = array("i", [-1]) * len(parent), array("i", [0]) * len(parent)
        queue = deque(children.get(0, ()))
        while queue:
            v = queue.popleft()
            queue.extend(children.get(v, ()))
            if final[v]:
                fail[v], pops[v] = 0, 1
                continue
            u, b = parent[v], byte[v]
            z, popped = fail[u], pops[u]
            while z >= 0 and (z << 8 | b) not in edges:
                popped += pops[z]
                z = fail[z]
            if z >= 0:
                fail[v], pops[v] = edges[z << 8 | b], popped
        return cls(edges, fail, pops)

    def count(self, word: bytes) -> int:
        """Pieces of the greedy segmentation; 1 if there is none."""
        get, fail, pops = self.edges.get, self.fail, self.pops
        node = n = 0
        for b in word:
            while (to := get(node << 8 | b)) is None:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = to
        while node > 0:
            n += pops[node]
            node = fail[node]
        return n if node == 0 else 1


class _Counts(dict):
    def __init__(self, automaton: Automaton) -> None:
        self.count = automaton.count

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self.count(b" " + word.encode("utf-8", "surrogatepass"))
        if len(word) < 64:
            self[word] = n
        return n


_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_words, n_tokens) of each row of ``docs`` (doc_id, text).

    The automaton, of the size of the vocabulary and not of the data, is built
    once and broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Automaton.build(load_vocabulary(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _Counts(shared.value).__getitem__
        for batch in batches:
            n_words, n_tokens = [], []
            for value in batch.column("text"):
                words = (value.as_py() or "").split()
                n_words.append(len(words))
                n_tokens.append(sum(map(get, words)))
            yield common.record(_COUNTS, batch.column("doc_id"), n_words, n_tokens)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts(common.table(spark, sf_dir, "documents"))
