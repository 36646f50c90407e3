import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa

from motifloom.llm import kernels
from motifloom.llm import near_dedup as nd

from .helpers import clashing, documents, odd, text, words


def corpus():
    rng = random.Random(11)
    rows = []
    for g in range(30):
        base = words(rng, rng.randrange(80, 300))
        for _ in range(rng.randrange(1, 5)):
            w = list(base)
            for _ in range(rng.randrange(0, 8)):
                w[rng.randrange(len(w))] = words(rng, 1)[0]
            rows.append((len(rows) * 3 % 101 + 1000 * g, " ".join(w)))
    return rows


def brute(rows):
    """Groups by comparing every pair of signatures."""
    a, b, some = nd.signatures_of(kernels.as_strings(pa.array([t for _, t in rows])))
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(np.flatnonzero(some), 2):
        if int(a[i] ^ a[j]).bit_count() <= nd.RADIUS and int(b[i] ^ b[j]).bit_count() <= nd.CONFIRM:
            x, y = sorted((find(rows[i][0]), find(rows[j][0])))
            root[y] = x
    return {(i, find(i)) for i, _ in rows if find(i) != i}


def test_every_pair_within_the_radius_collides():
    rng = np.random.default_rng(0)
    masks = nd.masks()
    assert len(masks) == 1 << nd.RADIUS + 1
    assert min(np.bitwise_count(masks[1:])) == 28
    for _ in range(300):
        flips = rng.choice(64, rng.integers(0, nd.RADIUS + 1), replace=False)
        difference = np.uint64(sum(1 << int(k) for k in flips))
        assert ((masks[1:] & difference) == 0).any()


def test_matches_brute_force(spark):
    rows = corpus()
    got = {tuple(r)[:2] for r in nd.copies(documents(spark, rows)).collect()}
    assert got == brute(rows) and len(got) > 30


def links(rows):
    """By document: how many different signatures match its own."""
    a, b, _ = nd.signatures_of(kernels.as_strings(pa.array([t for _, t in rows])))
    seen = {*zip(a.tolist(), b.tolist())}
    return {i: sum((x, y) != (int(p), int(q)) and (x ^ int(p)).bit_count() <= nd.RADIUS and (y ^ int(q)).bit_count() <= nd.CONFIRM for x, y in seen) for (i, _), p, q in zip(rows, a, b)}


def test_links_are_counted_once(spark):
    rows = corpus() + [(50_000 + i, t) for i, t in corpus()[:20]]
    want = links(rows)
    got = {r.doc_id: r.n_links for r in nd.copies(documents(spark, rows)).collect()}
    assert got == {i: want[i] for i in got} and max(got.values()) > 1 and min(got.values()) == 0


def test_hot_buckets_in_blocks():
    rng = random.Random(5)
    base = rng.getrandbits(64)
    a = np.array([base ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 6))) for _ in range(300)], dtype=np.uint64)
    a = np.unique(a)
    e = np.empty(len(a) * 255, dtype=nd._ENTRY)
    e["v"], e["a"], e["b"] = np.repeat(np.arange(1, 256, dtype=np.uint8), len(a)), np.tile(a, 255), 0
    want_pairs = [(i, j) for i in range(len(a)) for j in range(i) if int(a[i] ^ a[j]).bit_count() <= nd.RADIUS]
    degree = np.bincount(np.array(want_pairs).ravel(), minlength=len(a))
    for block, limit in ((10**6, 10**6), (7, 10**6), (7, 500), (50, 3000)):
        raw = [pa.record_batch([pa.array([x.tobytes() for x in np.array_split(e, 40)], pa.binary())], names=["entries"])]
        rows = [r for b in nd._compared(iter(raw), limit, block) for r in b.to_pylist()]
        hot = {}
        for r in rows:
            if r["entries"] is not None:
                assert len(r["entries"]) <= block * nd._ENTRY.itemsize and r["block"] not in hot.setdefault(r["key"], {})
                hot[r["key"]][r["block"]] = r
        assert bool(hot) == (block < 1000) and all(sorted(own) == list(range(len(own))) for own in hot.values())
        asked = [{"i": i, "blocks": [own[j], own[i]] if i != j else [own[i]]} for own in hot.values() for i in own for j in own if i <= j]
        kind = pa.schema([("i", pa.int32()), ("blocks", pa.list_(pa.struct([("block", pa.int32()), ("entries", pa.binary())])))])
        rows += [r for b in nd._crossed(iter([pa.RecordBatch.from_pylist(asked, kind)] if asked else [])) for r in b.to_pylist()]
        n = Counter()
        for r in rows:
            if r["entries"] is None and r["u"] == r["v"]:
                n[r["u"]] += r["n"]
        nodes = nd._node(a, np.zeros(len(a), dtype=np.uint64)).tolist()
        assert [n[x] for x in nodes] == degree.tolist()
        own = [(r["u"], r["v"]) for r in rows if r["entries"] is None and r["u"] != r["v"]]
        at = {x: i for i, x in enumerate(nodes)}
        got = nd.components(np.array([at[u] for u, _ in own]), np.array([at[v] for _, v in own]), len(a))
        want = nd.components(np.array([i for i, _ in want_pairs]), np.array([j for _, j in want_pairs]), len(a))
        assert (got == want).all()


def test_hot_buckets_over_a_table(spark):
    rng = random.Random(9)
    base = rng.getrandbits(62)
    a = sorted({base ^ sum(1 << k for k in rng.sample(range(62), rng.randrange(0, 5))) for _ in range(120)})
    table = spark.createDataFrame([(x, 0) for x in a], "a bigint, b bigint")
    want = nd.connected(nd.edges(table)).toPandas().sort_values("node").values.tolist()
    found = nd.edges(table, 10)
    assert nd.connected(found).toPandas().sort_values("node").values.tolist() == want and len(want) > 60


def test_no_text_is_lost_where_ids_repeat(spark):
    rng = random.Random(2)
    a, b = text(rng, 90), text(rng, 90)
    docs = documents(spark, [(1, a), (5, a), (5, b), (9, b)])
    assert sorted(tuple(r)[:2] for r in nd.drop_copies(docs).collect()) == [(1, a), (5, b)]
    assert {tuple(r)[:2] for r in nd.copies(docs).collect()} == {(5, 1), (9, 5)}
    near = b.rsplit(" ", 1)[0]
    docs = documents(spark, [(1, a), (1, a), (2, b), (2, near), (2, near), (2, None), (2, None)])
    kept = sorted(map(str, (tuple(r)[:2] for r in nd.drop_copies(docs).collect())))
    assert kept.count(str((1, a))) == 1 and kept.count("(2, None)") == 2 and len(kept) == 4
    assert nd.copies(docs).collect() == []


def test_large_bucket_is_compared_completely():
    a = np.arange(3000, dtype=np.uint64) << np.uint64(40)
    e = np.empty(3000, dtype=nd._ENTRY)
    e["v"], e["a"], e["b"] = 1, a & ~nd._MASKS[1], 0
    got = sum(len(i) for i, _ in nd.pairs_within(e))
    want = sum(int((np.bitwise_count(e["a"][i] ^ e["a"][i + 1 :]) <= nd.RADIUS).sum()) for i in range(3000))
    assert got == want


def test_connected(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {x: x for e in links for x in e}
    for _ in root:
        for u, v in links:
            root[u] = root[v] = min(root[u], root[v])
    got = {tuple(r) for r in nd.connected(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {(x, r) for x, r in root.items() if x != r}


def test_odd_rows(spark):
    docs = odd(spark)
    assert {tuple(r) for r in nd.copies(clashing(docs)).collect()} == {(5, 4, 0)}
    kept = nd.drop_copies(clashing(docs))
    assert kept.columns == clashing(docs).columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 9]
    assert nd.copies(docs.limit(0)).collect() == []
    assert nd.drop_copies(docs.limit(0)).collect() == []


def test_clean_texts_stay(spark):
    rng = random.Random(8)
    rows = [(i, text(rng, 60)) for i in range(200)]
    assert nd.copies(documents(spark, rows)).collect() == []


def near(texts):
    """Whether the two texts of each pair are near copies."""
    a, b, _ = nd.signatures_of(kernels.as_strings(pa.array([t for pair in texts for t in pair])))
    return (np.bitwise_count(a[::2] ^ a[1::2]) <= nd.RADIUS) & (np.bitwise_count(b[::2] ^ b[1::2]) <= nd.CONFIRM)


def test_short_and_lightly_edited_pairs_are_near():
    rng = random.Random(21)
    pairs = []
    while len(pairs) < 400:
        base = words(rng, rng.randrange(40, 120))
        w = list(base)
        for _ in range(rng.randrange(1, 8)):
            w[rng.randrange(len(w))] = words(rng, 1)[0]
        x, y = ({*zip(t, t[1:], t[2:])} for t in (base, w))
        if 0.7 <= len(x & y) / len(x | y) < 0.8:
            pairs.append((" ".join(base), " ".join(w)))
    assert near(pairs).mean() > 0.95


def test_same_words_in_another_order_are_not_near():
    rng = random.Random(22)
    pairs = []
    for _ in range(40):
        base = words(rng, 400)
        pairs.append((" ".join(base), " ".join(rng.sample(base, len(base)))))
    assert not near(pairs).any()
