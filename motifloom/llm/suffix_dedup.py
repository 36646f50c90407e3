"""Suffix-array deduplication by a common-prefix-aware distributed merge sort.

Finds every stretch of at least ``MIN_WORDS`` words that occurs more than once
in the corpus, within one text or across texts.

Which suffixes are sorted.  Every window of ``MIN_WORDS`` words is filed under
its minimiser, the position of the smallest hash of ``GRAM`` words among its
first ``REACH`` positions.  That depends on the window's words alone, so equal
windows have their minimisers at equal places and it is enough to sort the
suffixes that begin at minimisers (a sparse suffix array).  A suffix whose
first ``SHARED = MIN_WORDS - REACH + 1`` words occur nowhere else cannot belong
to a repeat; those are told apart first by the hashes of these words, and only
the others are exchanged.

The sort.  Each task sorts its suffixes into runs, cuts them at common
splitters, and front-codes each piece (the length of the prefix shared with the
suffix before, then only the rest).  Each receiving task merges its runs with a
loser tree whose nodes remember how long a prefix their loser shares with the
winner: two suffixes whose known prefixes differ in length are ordered without
looking at a character, and otherwise the comparison starts where the known
prefix ends.  Suffixes are ordered by their first ``MIN_WORDS`` words, deeper
order being without effect on the result.

Neighbours that share ``SHARED`` words form groups; the windows filed under a
group's suffixes are compared with each other by 64-bit fingerprints.  Splitters
are shorter than the shared prefix of any group, so none is cut in two.  They
come from a bounded sample of suffixes, which affects only how even the ranges
are.

Hot passages.  A group can't be cut by splitters, so first words that would
fill more than ``HOT_SHARE`` of a range, by the same sample, are not sorted:
the fingerprints of the windows filed under them are counted with partial
aggregation, and those that repeat are joined back, broadcast while they are
``MAX_BROADCAST`` at most.  The results are the same either way.

Of each repeated window the occurrence with the least (``doc_id``, hash of the
text, place) is the first; :func:`without_repeats` cuts out the others.

Defined results: null and empty texts, and texts of fewer than ``MIN_WORDS``
words, have no repeats; rows with a null ``doc_id`` cannot be named and are
left out; texts that share a ``doc_id`` are looked at each by itself, so two
stretches of one ``doc_id`` may lie in different texts; a repeated row repeats
all its passages, which are reported once; an empty table gives an empty
result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels

MIN_WORDS = 50
REACH = 25
GRAM = 4
SPLIT_BYTES = 24
SPLIT_DOCUMENTS = 4_000  #: about so many are asked for splitters, or four a range if that is more
SPLIT_SHARE = 4  #: and one suffix in so many of theirs is taken
RUN_RECORDS = 100_000
HOT_SHARE = 0.5  #: of an even range
HOT_LEAST = 16  #: occurrences in the sample that make first words hot
MAX_BROADCAST = 500_000
_POSITION_BITS = np.uint64(28)
_M = np.uint64(0x9E3779B97F4A7C15)
_M_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_ENTRY = np.dtype([("h", "<u8"), ("doc", "<i8"), ("k", "<i8"), ("p", "<u4")])


def minimisers(w: kernels.Words, min_words: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word index of each minimiser, and the first and last word index of the windows filed under it."""
    none = np.zeros(0, dtype=np.int64)
    n = len(w.hash) - min_words + 1
    if n <= 0:
        return none, none, none
    gram = kernels.rolled(w.hash, tuple(range(min(GRAM, min_words - reach + 1))))
    value = (gram >> _POSITION_BITS << _POSITION_BITS) | np.arange(len(gram), dtype=np.uint64)
    size = 1
    while size * 2 <= reach:
        value = np.minimum(value[:-size], value[size:])
        size *= 2
    if size < reach:
        value = np.minimum(value[: len(value) - (reach - size)], value[reach - size :])
    window = np.flatnonzero(w.row[:n] == w.row[min_words - 1 :])
    at = (value[window] & np.uint64((1 << 28) - 1)).astype(np.int64)
    if not len(at):
        return none, none, none
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    return at[first], window[first], window[last]


def hashed(w: kernels.Words, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each of these."""
    out = np.zeros(len(at), dtype=np.uint64)
    for o in range(n):
        out = (out + w.hash[at + o]) * _M
        out ^= out >> np.uint64(32)
    return kernels.mix(out)


def fingerprints(w: kernels.Words, n: int) -> np.ndarray:
    """64-bit fingerprint of the ``n`` words from each word on."""
    k = len(w.hash)
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(k, _M)]), dtype=np.uint64)
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(k, _M_INVERSE)]), dtype=np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(w.hash * up[:k], dtype=np.uint64)])
    return kernels.mix((total[n:] - total[:-n]) * down[: k - n + 1]) if k >= n else np.zeros(0, dtype=np.uint64)


def spelled(w: kernels.Words) -> tuple[bytes, np.ndarray]:
    """All words, a space after each, and where each begins (and the end)."""
    keep = np.zeros(len(w.data), dtype=bool)
    inside = kernels.WORD_BYTE[w.data]
    keep[inside] = True
    keep[w.end] = True  # every word is followed by a byte that is not of a word
    data = np.where(inside, w.data, np.uint8(32))[keep]
    return data.tobytes(), np.concatenate([[0], np.cumsum(w.end - w.start + 1)])


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the shared prefix, of which ``known`` bytes need no look."""
    n = min(len(a), len(b))
    while known < n:
        x, y = a[known : known + 64], b[known : known + 64]
        if x != y:
            k = min(len(x), len(y))
            difference = int.from_bytes(x[:k], "big") ^ int.from_bytes(y[:k], "big")
            return known + k - (difference.bit_length() + 7) // 8
        known += len(x)
    return n


def front_coded(suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Shared prefix with the one before, length of the rest, and the rests, of sorted suffixes."""
    shared, rest, before = [], [], b""
    for s in suffixes:
        k = common_prefix(before, s)
        shared.append(k)
        rest.append(s[k:])
        before = s
    return np.array(shared, dtype=np.uint32), np.array(list(map(len, rest)), dtype=np.uint32), b"".join(rest)


def decoded(shared: np.ndarray, length: np.ndarray, rests: bytes) -> Iterator[tuple[bytes, int]]:
    """(suffix, prefix shared with the one before) of a front-coded run."""
    at, s = 0, b""
    for k, n in zip(shared.tolist(), length.tolist()):
        s = s[:k] + rests[at : at + n]
        at += n
        yield s, k


def merged(runs: list[Iterable[tuple[bytes, int]]]) -> Iterator[tuple[int, bytes, int]]:
    """(run, suffix, prefix shared with the suffix before) in order, from sorted runs.

    A loser tree; ``known[k]`` is the prefix that the current suffix of run k
    shares with the one that beat it last, which is the latest output for all
    on the path of the winner, so unequal known prefixes decide at once.
    """
    streams = [iter(r) for r in runs]
    size = 1
    while size < len(streams):
        size *= 2
    head: list[bytes] = [b""] * size
    known = [-1] * size  # -1: the run has ended
    for k, s in enumerate(streams):
        if (first := next(s, None)) is not None:
            head[k], known[k] = first[0], 0
    loser = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        if known[a] < 0:
            return a, b
        x, y = head[a], head[b]
        k = common_prefix(x, y, known[a])
        if k == len(x) or (k < len(y) and x[k] < y[k]):
            known[b] = k
            return a, b
        known[a] = k
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, loser[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if size > 1 else 0
    while known[winner] >= 0:
        yield winner, head[winner], known[winner]
        after = next(streams[winner], None)
        head[winner], known[winner] = after if after is not None else (b"", -1)
        node = winner + size >> 1
        while node:
            winner, loser[node] = play(winner, loser[node])
            node >>= 1


def _ids(df: DataFrame) -> DataFrame:
    """(doc_id, print, text): rows that can be named, with the hash of the text to tell texts of one ``doc_id`` apart."""
    return df.selectExpr("cast(doc_id as bigint) doc_id", "xxhash64(text) print", "text").filter("doc_id is not null and text is not null")


def candidates(rows: DataFrame, parts: int, min_words: int, reach: int, hot: np.ndarray) -> DataFrame:
    """(doc_id, print, places): minimisers whose first words occur elsewhere too, packed; those whose hash is ``hot`` are left out."""
    out, shared = pa.schema([("part", pa.int32()), ("entries", pa.binary())]), min_words - reach + 1
    packed = pa.schema([("doc_id", pa.int64()), ("print", pa.int64()), ("places", pa.binary())])

    def spread(texts: pa.Array, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        w = kernels.words(texts)
        at = minimisers(w, min_words, reach)[0]
        h = hashed(w, at, shared)
        if len(hot):
            cold = ~np.isin(h, hot)
            at, h = at[cold], h[cold]
        if not len(at):
            return None
        e = np.empty(len(at), dtype=_ENTRY)
        e["h"], e["doc"], e["k"], e["p"] = h, batch.column("doc_id").to_numpy()[w.row[at]], batch.column("print").to_numpy()[w.row[at]], at - w.bounds[w.row[at]]
        part = (e["h"] >> np.uint64(20)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        e, part = e[order], part[order]
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        return common.record(out, part[cut].astype(np.int32), common.binary(np.split(e, cut[1:])))

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = [x for b in batches for x in b.column("entries").to_pylist()]
        e = np.frombuffer(b"".join(raw), dtype=_ENTRY)
        if not len(e):
            return
        _, which, count = np.unique(e["h"], return_inverse=True, return_counts=True)
        e = e[count[which] > 1]
        e = e[np.lexsort((e["k"], e["doc"]))]
        cut = np.flatnonzero(np.concatenate([[True], (e["doc"][1:] != e["doc"][:-1]) | (e["k"][1:] != e["k"][:-1])])) if len(e) else np.zeros(0, dtype=np.int64)
        if len(cut):
            yield common.record(packed, e["doc"][cut], e["k"][cut], common.binary(np.split(e["p"].copy(), cut[1:])))

    return rows.mapInArrow(common.over_slices(spread), "part int, entries binary").repartitionById(parts, "part").mapInArrow(repeated, "doc_id bigint, print bigint, places binary")


def sampled(rows: DataFrame, parts: int, min_words: int, reach: int, hot_share: float) -> tuple[list[bytes], np.ndarray]:
    """At most ``parts - 1`` prefixes that cut the suffixes into about even ranges; and the hashes of first words that more than ``hot_share`` of an even range begin with.

    From a sample in proportion to ``parts``, not to the corpus.  It decides
    how even the work is and not what is found.
    """
    shared = min_words - reach + 1
    schema = pa.schema([("prefix", pa.binary()), ("h", pa.int64())])
    size = min(SPLIT_BYTES, 2 * shared)  # a word and its space take two bytes at least

    def prefixes(texts: pa.Array, batch: pa.RecordBatch) -> pa.RecordBatch:
        w = kernels.words(texts)
        data, begin = spelled(w)
        at = minimisers(w, min_words, reach)[0]
        doc = batch.column("doc_id").to_numpy().astype(np.uint64)[w.row[at]]
        lot = kernels.mix(doc * _M + (at - w.bounds[w.row[at]]).astype(np.uint64))
        taken = at[lot % np.uint64(SPLIT_SHARE) == 0]
        return common.record(schema, pa.array([data[i : i + size] for i in begin[taken].tolist()], pa.binary()), hashed(w, taken, shared).view(np.int64))

    n = rows.count()
    share = min(1.0, max(SPLIT_DOCUMENTS, 4 * parts) / max(1, n))
    asked = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = asked.mapInArrow(common.over_slices(prefixes), "prefix binary, h bigint").toArrow()
    h, count = np.unique(found["h"].to_numpy(), return_counts=True)
    hot = h[count >= max(HOT_LEAST, hot_share * len(found) / parts)].view(np.uint64) if len(h) else np.zeros(0, dtype=np.uint64)
    ordered = sorted(x for x, own in zip(found["prefix"].to_pylist(), np.isin(found["h"].to_numpy().view(np.uint64), hot).tolist()) if not own)
    return (sorted({ordered[i * len(ordered) // parts] for i in range(1, parts)}) if ordered else []), hot


_SPAN = pa.schema([("doc_id", pa.int64()), ("print", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("later", pa.bool_())])
_SPAN_SQL = "doc_id bigint, print bigint, start_word bigint, end_word bigint, later boolean"


def _spans(doc: np.ndarray, k: np.ndarray, start: np.ndarray, later: np.ndarray, n: int) -> pa.RecordBatch:
    """Repeated windows of ``n`` words, in the order of document and start, as the stretches they cover without a gap between starts."""
    fresh = np.concatenate([[True], (np.diff(start) != 1) | (np.diff(doc) != 0) | (np.diff(k) != 0) | (np.diff(later.astype(np.int8)) != 0)])
    a = np.flatnonzero(fresh)
    b = np.append(a[1:], len(start)) - 1
    return common.record(_SPAN, doc[a], k[a], start[a], start[b] + n, later[a])


def _sorted_spans(rows: DataFrame, places: DataFrame, cuts: list[bytes], parts: int, min_words: int, reach: int) -> DataFrame:
    """Spans of the repeated windows, found by sorting the suffixes at ``places``."""
    shared = min_words - reach + 1
    run = pa.schema([("part", pa.int32()), ("shared", pa.binary()), ("length", pa.binary()), ("rests", pa.binary()), ("rests_bytes", pa.int64()), ("doc", pa.binary()), ("k", pa.binary()), ("p", pa.binary()), ("near", pa.binary()), ("windows", pa.binary()), ("prints", pa.binary())])
    kinds = ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'bigint' if f.type == pa.int64() else 'binary'}" for f in run)

    def runs_of(held: list[tuple[bytes, int, int, int, int, np.ndarray]]) -> pa.RecordBatch:
        held.sort(key=lambda r: r[0])
        keys = [r[0] for r in held]
        cut = [0, *(bisect_right(keys, c) for c in cuts), len(held)]
        out = []
        for part, (i, j) in enumerate(zip(cut[:-1], cut[1:])):
            if i < j:
                common_part, length, rests = front_coded(keys[i:j])
                own = held[i:j]
                columns = [common_part, length, *(np.array([r[c] for r in own], dtype=t) for c, t in ((1, np.int64), (2, np.int64), (3, np.uint32), (4, np.uint8))), np.array([len(r[5]) for r in own], dtype=np.uint8)]
                a, b, doc, k, p, near, windows = (c.tobytes() for c in columns)
                out.append((part, a, b, pa.compress(rests, codec="zstd", asbytes=True), len(rests), doc, k, p, near, windows, np.concatenate([r[5] for r in own]).tobytes()))
        return common.record(run, *map(list, zip(*out)))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, int, int, int, np.ndarray]] = []
        for batch in batches:
            ids, names, own = (batch.column(c).to_pylist() for c in ("doc_id", "print", "places"))
            for at, texts in kernels.slices(kernels.as_strings(batch.column("text"))):
                w = kernels.words(texts)
                data, begin = spelled(w)
                prints = fingerprints(w, min_words)
                place, window, until = minimisers(w, min_words, reach)
                cut = np.searchsorted(place, w.bounds)
                for k in range(len(texts)):
                    first, last = int(w.bounds[k]), int(w.bounds[k + 1])
                    here = slice(cut[k], cut[k + 1])
                    asked = np.isin(place[here] - first, np.frombuffer(b"".join(own[at + k]), dtype=np.uint32))
                    for i, a, b in zip(place[here][asked].tolist(), window[here][asked].tolist(), until[here][asked].tolist()):
                        held.append((data[begin[i] : begin[min(last, i + min_words)]], ids[at + k], names[at + k], i - first, i - b, prints[a : b + 1]))
                if len(held) >= RUN_RECORDS:
                    yield runs_of(held)
                    held = []
        if held:
            yield runs_of(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for b in batches for r in b.to_pylist()]
        if not held:
            return
        size = [len(r["shared"]) // 4 for r in held]
        base = np.concatenate([[0], np.cumsum(size)])
        streams = [decoded(np.frombuffer(r["shared"], np.uint32), np.frombuffer(r["length"], np.uint32), pa.decompress(r["rests"], r["rests_bytes"], codec="zstd", asbytes=True)) for r in held]
        following, order, group, groups = base[:-1].tolist(), [], [], 0
        for k, suffix, same in merged(streams):
            # the group goes on if ``shared`` whole words are the same, spaces included
            groups += same < 2 * shared or suffix.count(b" ", 0, same) < shared
            order.append(following[k])
            group.append(groups)
            following[k] += 1
        join = lambda c, t: np.concatenate([np.frombuffer(r[c], t) for r in held])
        doc, name, p, near, windows, prints = join("doc", np.int64), join("k", np.int64), join("p", np.uint32).astype(np.int64), join("near", np.uint8).astype(np.int64), join("windows", np.uint8).astype(np.int64), join("prints", np.uint64)
        of = np.empty(len(doc), dtype=np.uint64)
        of[order] = np.array(group, dtype=np.uint64)
        record = np.repeat(np.arange(len(doc)), windows)
        _, which, count = np.unique(prints ^ kernels.mix(of)[record], return_inverse=True, return_counts=True)
        # the windows of a record begin one word after another, the last of them ``near`` words before it
        offset = np.arange(len(record)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = p[record] - near[record] - windows[record] + 1 + offset
        on = np.flatnonzero(count[which] > 1)
        if not len(on):
            return
        which, doc, name, start = which[on], doc[record[on]], name[record[on]], start[on]
        by = np.lexsort((start, name, doc, which))
        which, doc, name, start = which[by], doc[by], name[by], start[by]
        head = np.flatnonzero(np.concatenate([[True], np.diff(which) != 0]))
        lead = np.repeat(head, np.diff(np.append(head, len(which))))
        later = (doc != doc[lead]) | (name != name[lead]) | (start != start[lead])
        by = np.lexsort((start, name, doc))
        yield _spans(doc[by], name[by], start[by], later[by], min_words)

    joined = rows.join(places, ["doc_id", "print"]).select("doc_id", "print", "text", "places")
    return joined.mapInArrow(suffixes, kinds).repartitionById(parts, "part").mapInArrow(merge, _SPAN_SQL)


def _hot_spans(rows: DataFrame, min_words: int, reach: int, hot: np.ndarray) -> DataFrame:
    """Spans of the repeated windows filed under hot minimisers: counted with partial aggregation, then looked up; no task gets all places of a window."""
    shared = min_words - reach + 1
    kind = pa.schema([("w", pa.int64()), ("doc_id", pa.int64()), ("print", pa.int64()), ("start", pa.int64())])
    total = pa.schema([*kind, ("n", pa.int64())])

    def windows(texts: pa.Array, batch: pa.RecordBatch) -> tuple[np.ndarray, ...] | None:
        w = kernels.words(texts)
        at, window, until = minimisers(w, min_words, reach)
        h = hashed(w, at, shared)
        own = np.flatnonzero(np.isin(h, hot))
        if not len(own):
            return None
        size = until[own] - window[own] + 1
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(window[own], size)
        key = kernels.mix(fingerprints(w, min_words)[place] ^ np.repeat(h[own], size)).view(np.int64)
        row = w.row[place]
        return key, batch.column("doc_id").to_numpy()[row], batch.column("print").to_numpy()[row], place - w.bounds[row]

    def counted(texts: pa.Array, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if (found := windows(texts, batch)) is None:
            return None
        by = np.lexsort(found[::-1])
        key, doc, name, start = (x[by] for x in found)
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return common.record(total, key[head], doc[head], name[head], start[head], np.diff(np.append(head, len(key))))

    def listed(texts: pa.Array, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = windows(texts, batch)
        return None if found is None else common.record(kind, *found)

    sums = rows.mapInArrow(common.over_slices(counted), "w bigint, doc_id bigint, print bigint, start bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "print", "start")).alias("first"))
    again = common.checkpoint(sums.filter("n > 1").select("w", "first"))
    if again.count() <= MAX_BROADCAST:
        again = F.broadcast(again)
    found = rows.mapInArrow(common.over_slices(listed), "w bigint, doc_id bigint, print bigint, start bigint").join(again, "w")
    flagged = found.select("doc_id", "print", "start", (F.struct("doc_id", "print", "start") != F.col("first")).alias("later"))

    def stretched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                doc, name, start, later = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "print", "start", "later"))
                by = np.lexsort((start, name, doc))
                yield _spans(doc[by], name[by], start[by], later[by], min_words)

    return flagged.mapInArrow(stretched, _SPAN_SQL)


_STRETCH = pa.schema([("doc_id", pa.int64()), ("print", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("n_later", pa.int64()), ("later", pa.list_(pa.int64()))])


def islands(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal stretches [start, end] covered by spans that overlap or touch."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def stretches(docs: DataFrame, min_words: int = MIN_WORDS, reach: int = REACH, hot_share: float = HOT_SHARE) -> DataFrame:
    """(doc_id, print, start_word, end_word, n_later, later): the maximal stretches covered by repeated passages; ``later`` has the starts and ends of what passages cover that begin earlier in the corpus too, ``n_later`` the words of these."""
    if not 1 <= reach <= min(255, min_words):
        raise ValueError("reach must be between 1 and 255, and not above min_words")
    spark, rows = docs.sparkSession, _ids(docs)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    cuts, hot = sampled(rows, parts, min_words, reach, hot_share)
    places = candidates(rows, parts, min_words, reach, hot).groupBy("doc_id", "print").agg(F.collect_list("places").alias("places"))
    spans = _sorted_spans(rows, places, cuts, parts, min_words, reach)
    if len(hot):
        spans = spans.unionByName(_hot_spans(rows, min_words, reach, hot))
    own = spans.groupBy("doc_id", "print").agg(F.collect_set(F.struct("start_word", "end_word", "later")).alias("s"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, name, found in zip(b.column("doc_id").to_pylist(), b.column("print").to_pylist(), b.column("s").to_pylist()):
                later = islands([(x["start_word"], x["end_word"]) for x in found if x["later"]])
                for a, e in islands([(x["start_word"], x["end_word"]) for x in found]):
                    inside = [x for x in later if a <= x[0] < e]
                    out.append((doc, name, a, e, sum(y - x for x, y in inside), [c for x in inside for c in x]))
            if out:
                yield common.record(_STRETCH, *map(list, zip(*out)))

    return own.mapInArrow(joined, "doc_id bigint, print bigint, start_word bigint, end_word bigint, n_later bigint, later array<bigint>")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, reach: int = REACH, hot_share: float = HOT_SHARE) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, n_later): the maximal stretches of words covered by repeated passages; ``n_later`` of their words go if each passage stays where it begins first."""
    return stretches(docs, min_words, reach, hot_share).select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), F.col("n_later").cast("int").alias("n_later"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, reach: int = REACH, hot_share: float = HOT_SHARE) -> DataFrame:
    """``docs`` with every repeated passage cut out but where it begins first (by ``doc_id``, hash of the text, and place).

    What goes reaches from the first cut word to the next that stays.  No row
    goes; ``n_chars``, where there is such a column, is brought up to date.
    Rows that repeat both ``doc_id`` and text are cut alike, so of passages
    that only they repeat none is lost.
    """
    own, mark, cut = (common.unused(docs, c) for c in ("own", "print", "cut"))
    cuts = stretches(docs, min_words, reach, hot_share).filter("n_later > 0").groupBy("doc_id", "print").agg(F.flatten(F.collect_list("later")).alias("later"))
    marked = docs.withColumns({own: F.col("doc_id").cast("bigint"), mark: F.xxhash64("text")})
    asked = marked.join(cuts.select(F.col("doc_id").alias(own), F.col("print").alias(mark), F.col("later").alias(cut)), [own, mark], "left").select(*(F.col(f"`{c}`") for c in (*docs.columns, cut)))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.select(names).columns)
            k = names.index("text")
            texts, later = columns[k].to_pylist(), b.column(cut).to_pylist()
            asked = [i for i, x in enumerate(later) if x]
            for i in asked:
                raw = texts[i].encode("utf-8", "surrogatepass")
                w = kernels.words(kernels.as_strings(pa.array([texts[i]], pa.large_string())), lower=False)
                ends, at, out = [*w.start.tolist(), len(raw)], 0, []
                for a, e in sorted(zip(later[i][::2], later[i][1::2])):
                    out.append(raw[at : ends[a]])
                    at = ends[e]
                texts[i] = b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")
            if asked:
                columns[k] = pa.array(texts, type=columns[k].type)
                if "n_chars" in names:
                    j = names.index("n_chars")
                    counts = columns[j].to_pylist()
                    for i in asked:
                        counts[i] = len(texts[i])
                    columns[j] = pa.array(counts, type=columns[j].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return asked.mapInArrow(run, docs.schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages of at least 50 words that repeat in the documents."""
    return repeats(common.table(spark, sf_dir, "documents"))
