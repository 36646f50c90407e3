"""Source mixing against SQL, BM25 search against brute force and SQL."""

import math
import random
from collections import Counter

import duckdb
import pytest

from motifloom.llm import bm25, source_mix

from .helpers import clashing, documents, odd, split, text

BENCH = "item_id bigint, text string"


def sql(query, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return con.execute(query).fetchall()


def corpus(spark):
    rng = random.Random(17)
    rows = [(i, text(rng, rng.randrange(1, 120), 400), rng.choice(["web"] * 6 + ["books", "code"])) for i in range(400)]
    return documents(spark, rows)


def placed(rows):
    return sorted(((d, s, n, e, round(p, 8)) for d, s, n, e, p in rows), key=str)


def test_mix_matches_sql(spark):
    docs = corpus(spark)
    got = source_mix.positions(docs).select("doc_id", "source", "n_tokens", "epoch", "position").collect()
    assert placed(got) == placed(sql(source_mix.ORACLE_SQL, documents=docs))
    assert [r.position for r in got] == sorted(r.position for r in got)


def test_mix_in_ranges(spark, monkeypatch):
    rng = random.Random(3)
    docs = documents(spark, [(i, text(rng, rng.randrange(1, 20), 400), rng.choice(["web"] * 8 + ["books", "\x00", None])) for i in range(500)])
    want = placed(sql(source_mix.ORACLE_SQL, documents=docs))
    for rows, most in ((3, 10**6), (40, 10**6), (3, -1)):
        monkeypatch.setattr(source_mix, "RANGE_ROWS", rows)
        monkeypatch.setattr(source_mix, "MAX_BROADCAST", most)
        assert placed(source_mix.positions(docs).select("doc_id", "source", "n_tokens", "epoch", "position").collect()) == want
    assert {s for _, s, *_ in want} == {"web", "books", "\x00", None}


def test_mix_follows_the_weights(spark):
    """At any time each source has supplied what its integrated weight asks for, but for one document."""
    docs = corpus(spark)
    rows = source_mix.positions(docs).collect()
    supply = Counter()
    for r in rows:
        if r.epoch == 0:
            supply[r.source] += r.n_tokens
    weight = [{s: n**e for s, n in supply.items()} for e in source_mix.EXPONENTS]
    weight = [{s: v / sum(w.values()) for s, v in w.items()} for w in weight]

    def demand(s, t):
        a, b, c = (w[s] for w in weight)
        u, v = min(t, 0.5), max(0.0, t - 0.5)
        return a * u + (b - a) * u * u + b * v + (c - b) * v * v

    total = max(n / demand(s, 1.0) for s, n in supply.items())
    for t in (0.1, 0.35, 0.5, 0.8, 1.0):
        for s in supply:
            given = sum(r.n_tokens for r in rows if r.source == s and r.position < t)
            assert abs(given - total * demand(s, t)) <= 121
    assert {r.doc_id for r in rows if r.epoch == 0} == set(range(400))
    assert max(r.epoch for r in rows) >= 1


def test_odd_mix(spark):
    docs = odd(spark)
    assert placed(source_mix.positions(clashing(docs)).collect()) == placed(sql(source_mix.ORACLE_SQL, documents=docs))
    whole = source_mix.mixed(clashing(docs))
    assert whole.columns == [*clashing(docs).columns, "mix_epoch", "mix_position"]
    assert whole.filter("mix_epoch = 0").count() == docs.count()
    assert source_mix.positions(docs.limit(0)).collect() == [] and source_mix.mixed(docs.limit(0)).collect() == []
    only_empty = docs.filter("doc_id in (2, 3)")
    assert {(r.doc_id, r.n_tokens, r.epoch, r.position) for r in source_mix.positions(only_empty).collect()} == {(2, 0, 0, 0.0), (3, 0, 0, 0.0)}


def brute(docs, queries, k):
    """(item_id, doc_id, score, rank) by scoring every document."""
    words = [(d, Counter(split(t))) for d, t in docs if d is not None]
    size = {i: sum(c.values()) for i, (_, c) in enumerate(words)}
    mean = sum(size.values()) / max(1, len(size))
    df = Counter(w for _, c in words for w in c)
    out = []
    for item, q in set(queries):
        if q is None:
            continue
        scored = []
        for i, (d, c) in enumerate(words):
            s = sum(math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size[i] / mean)) for w in set(split(q)) if w in c)
            if s > 0:
                scored.append((-round(s, 6), d))
        out += [(item, d, -s, r) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def ranked(rows):
    return sorted(((r.item_id, r.doc_id, r.score, r["rank"]) for r in rows), key=str)


def same(got, want):
    assert [(a, r) for a, _, _, r in sorted(got, key=lambda x: (str(x[0]), x[3]))] == [(a, r) for a, _, _, r in sorted(want, key=lambda x: (str(x[0]), x[3]))]
    a, b = ({(x[0], x[3], x[1]): x[2] for x in rows} for rows in (got, want))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=2e-6) for k in a)


@pytest.mark.parametrize(("block", "shard_docs", "terms"), [(128, 50_000, 2_000_000), (4, 40, 2_000_000), (3, 7, 60)])
def test_search_matches_brute_force(spark, monkeypatch, block, shard_docs, terms):
    monkeypatch.setattr(bm25, "BLOCK", block)
    monkeypatch.setattr(bm25, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(bm25, "MAX_TERMS", terms)
    rng = random.Random(29)
    rows = [(i, text(rng, rng.randrange(1, 80), 120)) for i in range(300)]
    queries = [(i, text(rng, rng.randrange(1, 8), 120)) for i in range(25)]
    got = bm25.search(documents(spark, rows), spark.createDataFrame(queries, BENCH), 5).collect()
    same(ranked(got), brute(rows, queries, 5))


def test_one_index_serves_many_searches(spark, tmp_path):
    rng = random.Random(30)
    rows = [(i, text(rng, rng.randrange(1, 80), 120)) for i in range(200)]
    bm25.index(clashing(documents(spark, rows))).write.parquet(str(tmp_path / "index"))
    shards = spark.read.parquet(str(tmp_path / "index"))
    assert shards.agg({"n_docs": "sum"}).first()[0] == 200
    for _ in range(2):
        queries = [(i, text(rng, rng.randrange(1, 8), 150)) for i in range(12)]
        same(ranked(bm25.searched(shards, spark.createDataFrame(queries, BENCH), 5).collect()), brute(rows, queries, 5))


def test_ties_are_ranked_by_id(spark):
    docs = documents(spark, [(i, "same words here") for i in (9, 3, 7, 1, 5)] + [(100, "others"), (101, "more others")])
    got = bm25.search(docs, spark.createDataFrame([(1, "words")], BENCH), 3).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [1, 3, 5]


def test_odd_search(spark):
    docs = odd(spark)
    queries = [(1, docs.filter("doc_id = 5").first().text[:40]), (1, "ok"), (2, None), (3, ""), (4, "漢字 OK"), (None, "ß"), (4, "漢字 OK")]
    table = spark.createDataFrame(queries, BENCH)
    got = bm25.search(clashing(docs), clashing(table.withColumnRenamed("item_id", "item")).withColumnRenamed("item", "id_").drop("item_id").withColumnRenamed("id_", "item_id")).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter((r.item_id, r.doc_id) for r in got) == Counter((i, d) for i, d, _, _ in brute(rows, queries, 10))
    assert bm25.search(docs.limit(0), table).collect() == [] and bm25.search(docs, table.limit(0)).collect() == []


def test_search_matches_sql(spark):
    docs = corpus(spark)
    rng = random.Random(1)
    queries = spark.createDataFrame([(i, text(rng, 6, 400)) for i in range(12)], BENCH)
    got = ranked(bm25.search(docs, queries).collect())
    same(got, sql(bm25.ORACLE_SQL, documents=docs, benchmark=queries))
