"""Fitted operators: held-out accuracy, and their parts against direct computations."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from motifloom.llm import kernels, quality, toxicity, url_filter

from .helpers import clashing, documents, odd, split, text, words

LABELS = "doc_id bigint, quality int, toxic int"


def test_isotonic_against_least_squares():
    rng = np.random.default_rng(3)
    count = rng.integers(0, 4, 30)
    total = np.array([rng.integers(0, c + 1) for c in count], dtype=float)
    got = quality.isotonic(count, total)
    assert (np.diff(got) >= 0).all()
    at = np.flatnonzero(count)
    # min-max formula
    for i in at:
        want = max(min(total[a : b + 1].sum() / count[a : b + 1].sum() for b in at[at >= i]) for a in at[at <= i])
        assert got[i] == pytest.approx(want)
    assert (quality.isotonic(np.zeros(5), np.zeros(5)) == 0.5).all()


def test_statistics():
    x = quality.statistics(kernels.as_strings(pa.array([None, "", "ABC abc abc 12\n|| #", "é"])))
    assert (x[0] == 0).all() and (x[1] == 0).all() and np.isfinite(x).all()
    named = dict(zip(quality.STATISTICS, x[2]))
    assert named["log_words"] == pytest.approx(math.log(5)) and named["upper"] == pytest.approx(1 / 3) and named["digits"] == pytest.approx(2 / 19) and named["bars"] == pytest.approx(2 / 19)


def test_letters_of_any_script():
    latin, cyrillic, cjk, signs = quality.statistics(kernels.as_strings(pa.array(["Abcd efgh ij", "\u0410\u0431\u0432\u0433 \u0434\u0435\u0436\u0437 \u0438\u0439", "\u6f22\u5b57\u6f22\u5b57 \u6f22\u5b57\u5b57\u6f22 \u5b57\u6f22", "A \u201c\u00ab\U0001f600"])))
    at = quality.STATISTICS.index
    for k in ("log_words", "word_length", "long_words", "stop_share", "distinct_words", "spaces"):
        assert latin[at(k)] == pytest.approx(cyrillic[at(k)]) == pytest.approx(cjk[at(k)]), k
    assert signs[at("upper")] == 1.0 and cyrillic[at("upper")] == 0


def test_statistics_by_counting():
    rng, stop = random.Random(8), set("#$%&*@^~<>{}[]\\=+_!")
    texts = ["".join(rng.choice(["a", "b", "Q", "7", " ", " ", "\n", "|", "#", "\u00e9", "\u0434", "\u6f22", "longlonglongword", "a a a"]) for _ in range(rng.randrange(0, 60))) for _ in range(80)]
    for t, x in zip(texts, quality.statistics(kernels.as_strings(pa.array(texts)))):
        w, n = split(t), max(1, len(t))
        letters = sum(c.isalpha() for c in t)
        per = max(1, len(w))
        want = [math.log1p(len(w)), min(20, sum(map(len, w)) / per), sum("A" <= c <= "Z" for c in t) / max(1, letters), sum("0" <= c <= "9" for c in t) / n, sum(c in stop for c in t) / n, t.count("|") / n, (t.count(" ") + t.count("\t")) / n]
        want += [math.log1p(len(t.encode()) / (t.count("\n") + 1)), len(set(w)) / per * math.log1p(per), sum(a == b for a, b in zip(w, w[1:])) / per, sum(len(x) > 12 for x in w) / per, sum(len(x) <= 3 for x in w) / per]
        assert x.tolist() == pytest.approx(want), t


def test_fit_against_one_direct_solution(spark):
    """Ridge and calibration from all labelled rows at once, without partitions."""
    rows, labels = graded(random.Random(12), 400)
    model = quality.fit(documents(spark, rows).repartition(5), spark.createDataFrame(labels + [(99_999, 1, 0), (None, 1, 0), (3, None, 0)], LABELS))
    held = {r.doc_id for r in spark.createDataFrame(labels, LABELS).filter("pmod(xxhash64(doc_id), 5) = 0").collect()}
    x, y = quality.statistics(kernels.as_strings(pa.array([t for _, t in rows]))), np.array([q for _, q, _ in labels], dtype=float)
    fit = np.array([i not in held for i, _ in rows])
    mean, scale = x[fit].mean(0), x[fit].std(0) + quality.LEAST_SCALE
    rng = np.random.default_rng(quality.SEED)
    direction, phase = rng.normal(0, 1 / quality.BANDWIDTH, (x.shape[1], quality.FEATURES)), rng.uniform(0, 2 * np.pi, quality.FEATURES)
    z = np.hstack([np.sqrt(2 / quality.FEATURES) * np.cos(np.clip((x - mean) / scale, -8, 8) @ direction + phase), np.ones((len(x), 1))])
    k = z.shape[1]
    weight = np.linalg.lstsq(np.vstack([z[fit], np.sqrt(quality.RIDGE * fit.sum() / k) * np.eye(k)]), np.concatenate([y[fit], np.zeros(k)]), rcond=None)[0]
    assert np.allclose(z @ weight, model.score(x), atol=1e-5)
    cells = quality.cell(z @ weight)
    curve = quality.isotonic(np.bincount(cells[~fit], minlength=quality.GRID), np.bincount(cells[~fit], weights=y[~fit], minlength=quality.GRID))
    assert (np.abs(curve - model.curve) < 1e-9).mean() > 0.99


def test_fourier_approximates_the_kernel():
    rng = np.random.default_rng(0)
    direction, phase = rng.normal(0, 1 / 2.0, (3, 20000)), rng.uniform(0, 2 * np.pi, 20000)
    x = rng.normal(size=(6, 3))
    z = quality.fourier(x, direction, phase)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * 4))
    assert np.abs(z @ z.T - want).max() < 0.03


def graded(rng, n):
    rows, labels = [], []
    for i in range(n):
        w = words(rng, rng.randrange(20, 150))
        bad = rng.random() < 0.3
        if bad:
            w = rng.choice([lambda w: [x + "###" for x in w], lambda w: [x.upper() for x in w], lambda w: " | ".join(w).split(" "), lambda w: [x for x in w[: 1 + len(w) // 12] for _ in range(12)]])(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_quality_on_held_out(spark):
    rows, labels = graded(random.Random(2), 900)
    docs = documents(spark, rows)
    model = quality.fit(docs, spark.createDataFrame(labels[:600], LABELS))
    got = {r.doc_id: r.probability for r in quality.score(docs, model).collect()}
    hits = [(got[i] >= quality.KEEP) == bool(q) for i, q, _ in labels[600:]]
    assert sum(hits) / len(hits) > 0.95
    kept = {r.doc_id for r in quality.keep_good(clashing(docs), model).collect()}
    assert kept == {i for i, p in got.items() if p >= quality.KEEP}


def test_partition_sums_give_the_same_fit(spark):
    rows, labels = graded(random.Random(2), 300)
    docs, known = documents(spark, rows), spark.createDataFrame(labels, LABELS)
    a, b = quality.fit(docs.repartition(7), known), quality.fit(docs.coalesce(1), known)
    assert np.allclose(a.weight, b.weight, atol=1e-6) and (a.curve == b.curve).mean() > 0.999


def test_odd_quality(spark):
    docs, none = clashing(odd(spark)), spark.createDataFrame([(1, None, None), (None, 1, 1), (77, 0, 0)], LABELS)
    model = quality.fit(docs, none)
    assert quality.keep_good(docs, model).count() == docs.count()
    assert {r.probability for r in quality.score(docs, model).collect()} == {0.5}
    some = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (6, 0, 0), (7, 0, 1)], LABELS)
    assert quality.score(docs, quality.fit(docs, some)).count() == docs.count()
    assert quality.score(docs.limit(0), model).collect() == [] and quality.fit(docs.limit(0), some).weight.any() == False  # noqa: E712


def insults(rng, n):
    rows, labels = [], []
    for i in range(n):
        w, bad = words(rng, rng.randrange(20, 200)), rng.random() < 0.25
        if bad:
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(["grobian", "knilch", "lump"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out(spark):
    rows, labels = insults(random.Random(6), 900)
    docs = documents(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels[:600], LABELS))
    assert len(model[0]) < 500
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    hits = [(got[i] > toxicity.THRESHOLD) == bool(t) for i, _, t in labels[600:]]
    assert sum(hits) / len(hits) > 0.97
    # the same by looking every feature up
    weight = dict(zip(model[0].tolist(), model[1].tolist()))
    for i, t in rows[:20]:
        _, place = toxicity.distinct(toxicity.places(kernels.words(kernels.as_strings(pa.array([t])))))
        z = weight.get(1 << toxicity.BITS, 0) + sum(weight.get(p, 0) for p in place.tolist())
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=2e-6)


def test_ftrl_against_the_formula():
    model, z, n = toxicity.Ftrl(), {}, {}
    rng = random.Random(1)
    for _ in range(200):
        at, y = sorted(rng.sample(range(12), 4)), rng.randrange(2)
        model.learn(np.array(at), y)
        at = [*at, 1 << toxicity.BITS]
        w = {i: 0.0 if abs(z.get(i, 0)) <= toxicity.L1 else (math.copysign(toxicity.L1, z[i]) - z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2) for i in at}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in at:
            z[i] = z.get(i, 0) + g - (math.sqrt(n.get(i, 0) + g * g) - math.sqrt(n.get(i, 0))) / toxicity.ALPHA * w[i]
            n[i] = n.get(i, 0) + g * g
    assert all(model.z[i] == pytest.approx(z[i]) for i in z)


def test_odd_toxicity(spark):
    docs = clashing(odd(spark))
    none = spark.createDataFrame([(1, None, None), (None, 1, 1), (77, 0, 1)], LABELS)
    assert toxicity.toxic(docs, none).collect() == []
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.5}
    some = spark.createDataFrame([(4, 1, 1), (4, 1, 1), (7, 0, 0), (2, 0, 0)], LABELS)
    assert toxicity.score(docs, toxicity.fit(docs, some)).count() == docs.count()
    assert toxicity.toxic(docs.limit(0), some).collect() == []


PAGES = "page_id bigint, url string, html string"


def pages(spark, n=400):
    rng, rows = random.Random(12), []
    for i in range(n):
        host = rng.choice(["best-casino", "win-poker", "free-pills"]) if rng.random() < 0.2 else rng.choice(["library", "museum", "weather", "recipes"])
        rows.append((i, f"https://www.{host}.example.org/{text(rng, 2, 50).replace(' ', '/')}/{rng.randrange(9999)}", ""))
    return spark.createDataFrame(rows, PAGES)


def normalised(url):
    return b"\x02" + re.sub("[0-9]+", "0", url.strip().lower().split("://", 1)[-1]).encode() + b"\x03"


def brute_score(train, url):
    """Interpolated by recursion over contexts counted directly."""

    def probability(kind, context, c):
        lower = probability(kind, context[1:], c) if context else 1 / url_filter.ALPHABET
        seen = [s[i] for s in kind for i in range(1, len(s)) if s[max(0, i - len(context)) : i] == context and i >= len(context)]
        return (seen.count(c) + len(set(seen)) * lower) / (len(seen) + len(set(seen))) if seen else lower

    s, kinds = normalised(url), [[normalised(u) for u, b in train if b == bad] for bad in (True, False)]
    return sum(math.log(probability(kinds[0], s[max(0, i - url_filter.ORDER) : i], s[i]) / probability(kinds[1], s[max(0, i - url_filter.ORDER) : i], s[i])) for i in range(1, len(s))) / (len(s) - 1)


def test_url_scores(spark):
    some = pages(spark, 60)
    got = url_filter.score(some).collect()
    held = {r.url for r in some.filter(url_filter._held(url_filter.F.col("url"))).collect()}
    train = [(r.url, r.bad) for r in got if r.url not in held]
    for r in got[:8]:
        assert r.score == pytest.approx(brute_score(train, r.url), abs=2e-6)
    joined = {r.page_id: r.score for r in url_filter.score(some, max_model=0).collect()}
    assert {r.page_id: r.score for r in got} == pytest.approx(joined, abs=2e-6)


def test_url_examples_beyond_the_list(spark):
    """Words that the list doesn't have, from a table of examples; measured on other URLs."""
    rng, rows = random.Random(5), []
    for i in range(900):
        bad = rng.random() < 0.3
        host = rng.choice(["lotto-jackpot", "jackpot-win", "megalotto", "winlotto"] if bad else ["library", "museum", "weather", "recipes"])
        rows.append((i, f"https://{rng.choice(['www', 'm', 'shop'])}.{host}{rng.randrange(99)}.example/{text(rng, 2, 60).replace(' ', '/')}/Ünï", bad))
    known = spark.createDataFrame([(u, b) for _, u, b in rows[:600]] + [(None, True), ("http://x.example", None)], "url string, rejected boolean")
    asked = spark.createDataFrame([(i, u, "") for i, u, _ in rows[600:]], PAGES)
    got = {r.page_id for r in url_filter.rejected(asked, known).collect()}
    bad = {i for i, _, b in rows[600:] if b}
    assert len(got & bad) >= 0.95 * len(bad) and len(got - bad) <= 0.01 * 300
    scored = url_filter.score(asked, known)
    assert not any(r.bad for r in scored.collect())
    held = {r.url for r in known.filter(url_filter._held(url_filter.F.col("url"))).collect()}
    train = [(u, b) for _, u, b in rows[:600] if u not in held]
    for r in scored.orderBy("page_id").limit(2).collect():
        assert r.score == pytest.approx(brute_score(train, r.url), abs=2e-6)


def test_url_filter(spark):
    some = pages(spark)
    bad = {r.page_id for r in url_filter.score(some).collect() if r.bad}
    got = {r.page_id for r in url_filter.rejected(clashing(some)).collect()}
    assert len(got & bad) >= 0.95 * len(bad) and len(got - bad) <= 0.01 * some.count()


def test_odd_urls(spark):
    rows = [(1, None, ""), (2, "", ""), (None, "http://casino.example/x", ""), (3, "http://a.example/" + "y" * 30_000, None), (4, "http://casino.example/x", ""), (4, "http://casino.example/x", "")]
    some = spark.createDataFrame(rows, PAGES)
    assert sorted((r.page_id or 0, r.bad) for r in url_filter.score(clashing(some)).collect()) == [(0, True), (2, False), (3, False), (4, True), (4, True)]
    assert url_filter.rejected(some).count() >= 0 and url_filter.rejected(some.limit(0)).collect() == []


def test_labels_without_documents_do_not_use_up_the_bound(spark):
    rng = random.Random(12)
    docs = documents(spark, [(i, text(rng, 60, 200)) for i in range(40)])
    own = [(i, 1, i % 2) for i in range(40)]
    want = toxicity.fit(docs, spark.createDataFrame(own, LABELS), 40)
    got = toxicity.fit(docs, spark.createDataFrame([(i, 1, 0) for i in range(1000, 1400)] + own, LABELS), 40)
    assert len(want[0]) and all(np.array_equal(x, y) for x, y in zip(got, want))
