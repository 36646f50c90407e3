import random
from collections import Counter

import pytest

from motifloom.llm import suffix_dedup as sd

from .helpers import clashing, documents, odd, split, text, words


def brute(rows, n):
    """Maximal stretches covered by windows that occur twice, with the words covered by windows that occur earlier too."""
    docs = [(i, split(t)) for i, t in rows if i is not None]
    count = Counter(tuple(w[k : k + n]) for _, w in docs for k in range(len(w) - n + 1))
    first = {}
    for i, w in sorted(docs):
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), (i, k))
    out = set()
    for i, w in docs:
        spans, later = [], set()
        for k in range(len(w) - n + 1):
            own = tuple(w[k : k + n])
            if count[own] > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + n
                else:
                    spans.append([k, k + n])
                if first[own] != (i, k):
                    later |= set(range(k, k + n))
        out |= {(i, a, b, b - a, len(later & set(range(a, b)))) for a, b in spans}
    return out


def corpus(seed, n=40):
    rng = random.Random(seed)
    shared = [words(rng, rng.randrange(8, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        w = words(rng, rng.randrange(0, 120))
        for s in rng.sample(shared, rng.randrange(0, 4)):
            k = rng.randrange(len(w) + 1)
            w[k:k] = s
        rows.append((i, " ".join(w)))
    return rows + [(n + 1, rows[0][1]), (n + 2, "a b " * 40)]


@pytest.mark.parametrize("n,reach,hot", [(10, 4, sd.HOT_SHARE), (12, 6, sd.HOT_SHARE), (50, 25, sd.HOT_SHARE), (10, 4, 0.0), (12, 6, 0.01), (50, 25, 0.0)])
def test_matches_brute_force(spark, monkeypatch, n, reach, hot):
    monkeypatch.setattr(sd, "HOT_LEAST", 1)
    rows = corpus(n)
    got = {tuple(r) for r in sd.repeats(documents(spark, rows), n, reach, hot).collect()}
    assert got == brute(rows, n) and got
    if hot == 0:  # by a shuffled join
        monkeypatch.setattr(sd, "MAX_BROADCAST", -1)
        assert {tuple(r) for r in sd.repeats(documents(spark, rows), n, reach, hot).collect()} == got


def test_hot_words_are_found(spark):
    rng = random.Random(6)
    shared, rows = text(rng, 60), []
    for i in range(300):
        rows.append((i, f"{text(rng, 70)} {shared if i % 2 else text(rng, 60)} {text(rng, 40)}"))
    docs = documents(spark, rows)
    cuts, hot = sd.sampled(sd._ids(docs), 40, sd.MIN_WORDS, sd.REACH, sd.HOT_SHARE)
    assert 0 < len(hot) <= 6 and len(cuts) > 20
    monkey = {tuple(r) for r in sd.repeats(docs, hot_share=0.05).collect()}
    assert monkey == brute(rows, 50) and len(monkey) == 150


def test_cut_out(spark):
    rows = [(i, t.upper() if i % 3 else f"É, {t}!") for i, t in corpus(12)] + [(0, None), (None, "x"), (900, "İ ok " + corpus(12)[2][1])]
    n = 12
    docs = clashing(documents(spark, rows))
    out = sd.without_repeats(docs, n, 6)
    assert out.schema == docs.schema and out.count() == docs.count()
    got = {(r.doc_id, r.n_chars): r.text for r in out.collect()}
    named = [(i, t) for i, t in rows if i is not None and t is not None]
    later, seen = {}, {}
    for i, t in sorted(named):
        w = split(t)
        for k in range(len(w) - n + 1):
            if seen.setdefault(tuple(w[k : k + n]), (i, k)) != (i, k):
                later.setdefault(i, set()).update(range(k, k + n))
    for i, t in named:
        want = [x for k, x in enumerate(split(t)) if k not in later.get(i, ())]
        kept = [x for (d, c), x in got.items() if d == i and x is not None]
        assert [split(x) for x in kept] == [want] and [c for (d, c), x in got.items() if d == i and x is not None] == [len(kept[0])]
        if i not in later:
            assert kept == [t]
    assert later and sd.without_repeats(docs.limit(0), n, 6).collect() == []


def test_texts_of_one_id_are_apart(spark):
    rng = random.Random(7)
    a, b, c = text(rng, 60), text(rng, 60), text(rng, 60)
    docs = documents(spark, [(1, f"{a} {b}"), (1, f"{c} {b}"), (1, f"{c} {b}"), (2, f"zz {a}")])
    got = sorted(tuple(r) for r in sd.stretches(docs).select("doc_id", "start_word", "end_word").collect())
    assert got == [(1, 0, 120), (1, 0, 120), (2, 1, 61)]
    whole = " ".join(r.text for r in sd.without_repeats(docs).collect())
    assert whole.count(a) == 1 and whole.count(b) in (1, 2) and whole.count(c) == 2
    for bad in (0, 300, 51):
        with pytest.raises(ValueError):
            sd.repeats(docs, 50, bad)


def test_odd_rows(spark):
    got = sorted(tuple(r) for r in sd.repeats(clashing(odd(spark))).collect())
    assert got == [(4, 0, 90, 90, 0), (5, 0, 90, 90, 90)]
    assert sd.repeats(odd(spark).limit(0)).collect() == []


def test_merge_orders_and_knows_prefixes():
    rng = random.Random(3)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 90))) for _ in range(rng.randrange(0, 40))) for _ in range(7)]
    coded = [sd.front_coded(r) for r in runs]
    assert [[s for s, _ in sd.decoded(*c)] for c in coded] == runs
    out = list(sd.merged([sd.decoded(*c) for c in coded]))
    assert [s for _, s, _ in out] == sorted(s for r in runs for s in r)
    before = b""
    for _, s, known in out:
        assert known == sd.common_prefix(before, s)
        before = s
    assert [s for _, s, _ in sd.merged([iter(())])] == []


def test_repeat_inside_one_text(spark):
    t = text(random.Random(1), 55)
    got = [tuple(r) for r in sd.repeats(documents(spark, [(1, f"{t} zz {t}"), (2, "x")])).collect()]
    assert sorted(got) == [(1, 0, 55, 55, 0), (1, 56, 111, 55, 55)]
