"""Near-deduplication by minwise bits and covering locality-sensitive hashing.

Each text gets two independent signatures of 64 one-bit minwise hashes: one of
its words, one of its pairs of adjacent words.  Two texts are near copies if the
first differ in at most ``RADIUS`` bits and the second, which only confirms, in
at most ``CONFIRM``; near copies of near copies form a group.  A bit differs
with half of one minus the Jaccard similarity, so a few edits cost few bits;
those of a SimHash differ with the angle, which is like the root of that.

Covering hashing finds all pairs within the radius, not just most: every bit
has a non-zero vector of ``RADIUS + 1`` bits, and table ``v`` (one for each
non-zero vector) keeps the bits whose vector has an odd overlap with ``v``.
Whatever bits two hashes differ in, up to ``RADIUS`` of them, some ``v`` is
orthogonal to them all, so that table masks the difference away and the pair
collides there.  The vectors are those of a code whose words all have weight 28
or more, so no table keeps fewer bits than that.

Equal signatures are collapsed before anything is paired, so any number of
exact copies costs no more than one.  Table entries travel as packed arrays,
each bucket to the partition of its key; buckets are compared completely, with
no cap on their size: one of over ``BLOCK`` entries is cut into blocks, and its
pairs of blocks are compared in tasks of their own, so no task holds a whole
hot bucket.  Each partition passes on a spanning forest of what it found, and
of each signature the number of others it matches (a pair is counted in the
first of the tables where it collides).  Groups are the connected components,
by alternating star steps towards the larger and the lesser nodes, with a
checkpoint each.

Defined results: null and empty texts, and texts without any word, have no
signature and are near copies of nothing; rows with a null ``doc_id`` cannot be
named, so they are left alone.  Every other row counts by itself: of each group
the row of the smallest ``doc_id`` stays (of rows that share it, the one whose
text has the smallest hash).  So rows of one ``doc_id`` with different texts
belong to different groups, and no text goes unless a near copy of it stays in
the table or leads, from copy to copy, to one that does.  Rows that repeat both
``doc_id`` and text are copies, of which :func:`drop_copies` keeps one; other
columns are kept by it, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels

RADIUS = 7
CONFIRM = 16
SEED = 7
_ENTRY = np.dtype([("v", "u1"), ("a", "<u8"), ("b", "<u8")])
BLOCK = 20_000  #: entries of a bucket that one task compares with each other
MAX_BROADCAST = 500_000  #: so many names of rows that go are broadcast; more are joined
_PARTITION_MB = 48
_CHUNK = 2000


def minwise(row: np.ndarray, feature: np.ndarray, n: int, seed: int) -> np.ndarray:
    """64 one-bit minwise hashes of each of ``n`` rows, of which ``row`` (ascending) has these features."""
    out = np.zeros(n, dtype=np.uint64)
    cut = np.searchsorted(row, np.arange(n + 1))
    some = np.flatnonzero(np.diff(cut))
    if len(some):
        x, start = (feature >> np.uint64(32)).astype(np.uint32), cut[some]
        draws = np.random.default_rng(seed).integers(0, 1 << 32, (64, 3), dtype=np.uint32)
        for k, (own, one, two) in enumerate(draws):
            h = (x ^ own) * (one | np.uint32(1))
            h ^= h >> np.uint32(15)
            h *= two | np.uint32(1)
            h ^= h >> np.uint32(16)
            out[some] |= (np.minimum.reduceat(h, start) & np.uint32(1)).astype(np.uint64) << np.uint64(k)
    return out


def _distinct(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's hashes (44 bits of them, mixed) once, rows ascending."""
    key = np.unique(row.astype(np.uint64) << np.uint64(44) | hashes >> np.uint64(20))
    return (key >> np.uint64(44)).astype(np.int64), kernels.mix(key & np.uint64(2**44 - 1))


def signatures_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both signatures of each text, and whether it has any word."""
    w = kernels.words(texts)
    n = len(texts)
    pairs = kernels.rolled(w.hash, (0, 1))
    inside = kernels.same_row(w.row, 1)
    one = minwise(*_distinct(w.row, w.hash), n, SEED)
    two = minwise(*_distinct(w.row[: len(pairs)][inside], pairs[inside]), n, SEED + 1)
    return one, two, np.diff(w.bounds) > 0


def masks() -> np.ndarray:
    """The mask of each table, by its vector v from 0 (unused) to 2 ** (RADIUS + 1) - 1.

    Bit k has the vector (1, k, f(k)) with a bent function f of six variables,
    so the words of the code are affine functions of k, of weight 32 (or 64),
    and those plus f, of weight 28 or 36.
    """
    k = np.arange(64, dtype=np.uint64)
    bit = lambda i: k >> np.uint64(i) & np.uint64(1)
    own = np.uint64(1) | k << np.uint64(1) | (bit(0) & bit(1) ^ bit(2) & bit(3) ^ bit(4) & bit(5)) << np.uint64(RADIUS)
    v = np.arange(1 << RADIUS + 1, dtype=np.uint64)
    odd = np.bitwise_count(own[None, :] & v[:, None]) & 1
    return (odd.astype(np.uint64) << k).sum(axis=1, dtype=np.uint64)


_MASKS = masks()


def _keys(v: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The bucket that each signature ``a`` has in table ``v``."""
    return kernels.mix((a & _MASKS[v]) ^ (v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _node(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit name for a signature."""
    return kernels.mix(a ^ kernels.mix(b)).astype(np.int64)


def components(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component, for edges between 0 .. n - 1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while (nxt := root[root] != root).any():
            root[nxt] = root[root[nxt]]
        if (root[u] == root[v]).all():
            return root


def pairs_within(entries: np.ndarray, radius: int = RADIUS, confirm: int = CONFIRM) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of the near copies among table entries, each bucket compared completely."""
    if not len(entries):
        return
    key = _keys(entries["v"], entries["a"])
    order = np.argsort(key)
    key, a, b = key[order], entries["a"][order], entries["b"][order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    end = np.repeat(np.append(start[1:], len(key)), np.diff(np.append(start, len(key))))
    at, step = np.arange(len(key)), 1
    while len(at := at[at + step < end[at]]):
        near = at[(np.bitwise_count(a[at] ^ a[at + step]) <= radius) & (np.bitwise_count(b[at] ^ b[at + step]) <= confirm)]
        if len(near):
            yield order[near], order[near + step]
        step += 1


def first_table(v: np.ndarray, difference: np.ndarray) -> np.ndarray:
    """Whether ``v`` is the first table whose mask hides each of these differences."""
    first, at, t = np.ones(len(v), dtype=bool), np.arange(len(v)), 1
    while len(at := at[v[at] > t]):
        hidden = difference[at] & _MASKS[t] == 0
        first[at[hidden]] = False
        at, t = at[~hidden], t + 1
    return first


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("block", pa.int32()), ("entries", pa.binary())])
_EDGE_SQL = "u bigint, v bigint, n bigint, key bigint, block int, entries binary"


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges with the same components."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = components(at[: len(u)], at[len(u) :], len(names))
    own = np.flatnonzero(root != np.arange(len(names)))
    return names[own], names[root[own]]


class _Found:
    """Collects pairs in bounded memory: a forest of them, and how often each node is in one."""

    def __init__(self) -> None:
        self.u, self.v, self.held = [], [], 0
        self.node, self.n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.fresh: list[np.ndarray] = []

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        """Pairs of entries of the same table each."""
        u, v = _node(x["a"], x["b"]), _node(y["a"], y["b"])
        first = first_table(x["v"], x["a"] ^ y["a"])
        self.fresh += [u[first], v[first]]
        self.u.append(u)
        self.v.append(v)
        self.held += len(u)
        if self.held > 2_000_000:
            self.settle()

    def settle(self) -> None:
        if self.u:
            u, v = _forest(np.concatenate(self.u), np.concatenate(self.v))
            self.u, self.v, self.held = [u], [v], 0
            nodes = np.concatenate([self.node, *self.fresh])
            self.node, at = np.unique(nodes, return_inverse=True)
            weight = np.concatenate([self.n, np.ones(len(nodes) - len(self.n), dtype=np.int64)])
            self.n, self.fresh = np.bincount(at, weights=weight, minlength=len(self.node)).astype(np.int64), []

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Edges (u, v) with n = 0, and loops (node, node) with the links of the node."""
        self.settle()
        if self.u:
            u, v, n = np.concatenate([self.u[0], self.node]), np.concatenate([self.v[0], self.node]), np.concatenate([np.zeros(len(self.u[0]), dtype=np.int64), self.n])
            none = [None] * len(u)
            yield common.record(_EDGE, u, v, n, none, none, none)


def _blocks(key: int, first: int, entries: np.ndarray, block: int) -> pa.RecordBatch:
    """Entries of a hot bucket as blocks from number ``first`` on."""
    cut = [entries[i : i + block] for i in range(0, len(entries), block)]
    none = [None] * len(cut)
    return common.record(_EDGE, none, none, none, [key] * len(cut), list(range(first, first + len(cut))), common.binary(cut))


def _compared(batches: Iterator[pa.RecordBatch], limit: int, block: int) -> Iterator[pa.RecordBatch]:
    """Compares the buckets of a partition and passes hot ones on in blocks.

    At most ``limit`` entries are held, besides buckets that aren't hot: when
    there are more, those of hot buckets leave.
    """
    held: list[np.ndarray] = []
    size, blocks = 0, {}

    def divert() -> Iterator[pa.RecordBatch]:
        nonlocal held
        e = np.concatenate(held) if held else np.zeros(0, dtype=_ENTRY)
        key = _keys(e["v"], e["a"])
        order = np.argsort(key, kind="stable")
        e, key = e[order], key[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        end, stays = np.append(start[1:], len(key)), np.ones(len(key), dtype=bool)
        known = np.isin(key[start], np.array(list(blocks), dtype=np.uint64)) if blocks else np.zeros(len(start), dtype=bool)
        for i in np.flatnonzero((end - start > block) | known):
            k, own = int(key[start[i]]), e[start[i] : end[i]]
            yield _blocks(int(np.uint64(k).astype(np.int64)), blocks.get(k, 0), own, block)
            blocks[k] = blocks.get(k, 0) - (-len(own) // block)
            stays[start[i] : end[i]] = False
        held = [e[stays]]

    for batch in batches:
        for raw in batch.column("entries"):
            held.append(np.frombuffer(raw.as_py(), dtype=_ENTRY))
            size += len(held[-1])
            if size > limit:
                yield from divert()
                size = len(held[0])
                limit = max(limit, 2 * size)
    yield from divert()
    found, e = _Found(), held[0]
    for i, j in pairs_within(e):
        found.add(e[i], e[j])
    yield from found.rows()


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares pairs of blocks of one bucket (``i`` and ``j``; ``i`` alone where both are the same)."""
    for batch in batches:
        for one, own in zip(batch.column("i").to_pylist(), batch.column("blocks").to_pylist()):
            found = _Found()
            own = [np.frombuffer(b["entries"], dtype=_ENTRY) for b in sorted(own, key=lambda b: b["block"] != one)]
            x, y, same = own[0], own[-1], len(own) == 1
            for at in range(0, len(x), 64):
                part = x[at : at + 64]
                near = (np.bitwise_count(part["a"][:, None] ^ y["a"]) <= RADIUS) & (np.bitwise_count(part["b"][:, None] ^ y["b"]) <= CONFIRM)
                i, j = np.nonzero(near)
                later = j > i + at if same else np.ones(len(i), dtype=bool)
                found.add(part[i[later]], y[j[later]])
            yield from found.rows()


def edges(signatures: DataFrame, block: int = BLOCK) -> DataFrame:
    """(u, v, n): edges between the nodes of distinct signatures (a, b) that connect all near copies, and loops with the number ``n`` of signatures that match a node's."""
    spark = signatures.sparkSession
    tables = len(_MASKS) - 1
    size = signatures.count() * tables * _ENTRY.itemsize
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (_PARTITION_MB << 20)))
    schema, limit = pa.schema([("p", pa.int32()), ("entries", pa.binary())]), (4 * _PARTITION_MB << 20) // _ENTRY.itemsize

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(i, _CHUNK)
                a, b = (part.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
                out = np.empty(len(a) * tables, dtype=_ENTRY)
                out["v"], out["a"], out["b"] = np.repeat(np.arange(1, tables + 1, dtype=np.uint8), len(a)), np.tile(a, tables), np.tile(b, tables)
                p = (_keys(out["v"], out["a"]) >> np.uint64(20)) % np.uint64(parts)
                order = np.argsort(p, kind="stable")
                out, p = out[order], p[order]
                cut = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
                yield common.record(schema, p[cut].astype(np.int32), common.binary(np.split(out, cut[1:])))

    packed = signatures.select("a", "b").mapInArrow(spread, "p int, entries binary")
    found = common.checkpoint(packed.repartitionById(parts, "p").mapInArrow(lambda batches: _compared(batches, limit, block), _EDGE_SQL))
    links, hot = found.filter("entries is null").select("u", "v", "n"), found.filter("entries is not null")
    if hot.isEmpty():
        return links
    count = hot.groupBy("key").agg((F.max("block") + 1).alias("count"))  # a row a hot bucket
    other = F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("other")
    asked = hot.join(count, "key").select("key", "block", "entries", other).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.struct("block", "entries").alias("b"))
    crossed = asked.groupBy("key", "i", "j").agg(F.collect_list("b").alias("blocks")).select("i", "blocks").mapInArrow(_crossed, _EDGE_SQL)
    return links.unionByName(common.checkpoint(crossed.select("u", "v", "n")))


def _mark(links: DataFrame) -> tuple:
    """Tells two sets of edges apart."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v) that is not the smallest of its component.

    The least neighbour of each node is a partially aggregated minimum, joined
    back; a hub's edges may be split between tasks.
    """
    now = common.checkpoint(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    mark = _mark(now)

    def least(edges: DataFrame) -> DataFrame:
        return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")

    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        down = least(up)
        down = down.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        now, before = common.checkpoint(down), mark
        if (mark := _mark(now)) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


_SIGNATURE = pa.schema([("doc_id", pa.int64()), ("print", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("node", pa.int64())])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, print, a, b, node) of each row that has a ``doc_id`` and a word; ``print`` is the hash of the text."""

    def work(texts: pa.Array, batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b, some = signatures_of(texts)
        return common.record(_SIGNATURE, batch.column("doc_id"), batch.column("print"), a.view(np.int64), b.view(np.int64), _node(a, b)).filter(pa.array(some))

    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "xxhash64(text) print", "text").filter("doc_id is not null and text is not null")
    return rows.mapInArrow(common.over_slices(work), "doc_id bigint, print bigint, a bigint, b bigint, node bigint")


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, print, a, b, node, n): signatures with the number of rows that repeat each."""
    return common.checkpoint(signatures(docs).groupBy("doc_id", "print", "a", "b", "node").agg(F.count("*").alias("n")))


def _gone(rows: DataFrame) -> DataFrame:
    """(doc_id, print, kept_id, n_links) of the rows that go."""
    nodes = common.checkpoint(rows.groupBy("a", "b", "node").agg(F.min(F.struct("doc_id", "print")).alias("first"), F.count("*").alias("rows")))
    found = edges(nodes)
    links = found.filter("u = v").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("links"))
    placed = common.checkpoint(nodes.join(connected(found), "node", "left").select("node", "first", "rows", F.coalesce("root", "node").alias("root")))
    groups = placed.groupBy("root").agg(F.min("first").alias("first"), F.sum("rows").alias("rows")).filter("rows > 1")
    kept = placed.select("node", "root").join(groups, "root").join(links, "node", "left").select("node", F.col("first.doc_id").alias("kept_id"), F.col("first.print").alias("kept_print"), F.coalesce("links", F.lit(0)).cast("int").alias("n_links"))
    return rows.select("doc_id", "print", "node").join(kept, "node").filter("doc_id <> kept_id or print <> kept_print").select("doc_id", "print", "kept_id", "n_links")


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, kept_id, n_links): each document that goes, with the one of its group that stays and the number of different texts that match its own.

    A document whose rows differ may go for several; one that goes for another row of itself is left out.
    """
    return _gone(_rows(docs)).filter("doc_id <> kept_id").groupBy("doc_id", "kept_id").agg(F.max("n_links").alias("n_links"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies."""
    own, mark, i, p = (common.unused(docs, c) for c in ("own", "print", "gone_id", "gone_print"))
    rows = _rows(docs)
    gone = common.checkpoint(_gone(rows).select(F.col("doc_id").alias(i), F.col("print").alias(p)).distinct())
    again = common.checkpoint(rows.filter("n > 1").select(F.col("doc_id").alias(i), F.col("print").alias(p)).join(gone, [i, p], "left_anti"))

    def listed(names: DataFrame) -> DataFrame:
        return F.broadcast(names) if names.count() <= MAX_BROADCAST else names

    marked = docs.withColumns({own: F.col("doc_id").cast("bigint"), mark: F.xxhash64("text")})
    at = (F.col(own) == F.col(i)) & (F.col(mark) == F.col(p))
    kept = marked.join(listed(gone), at, "left_anti")
    if not again.isEmpty():
        once = kept.join(listed(again), at, "left_anti")
        kept = once.unionByName(kept.join(listed(again), at, "left_semi").dropDuplicates([own, mark]))
    return kept.drop(own, mark)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near copies among all documents, each with the document that stays for it and its number of links."""
    return copies(common.table(spark, sf_dir, "documents"))
