import itertools
import random
from collections import Counter

import numpy as np
import pytest

from motifloom.config import Config, validate
from motifloom.functions import arithmetic as ar
from motifloom.operators import codec, importance, regions, select, templates
from motifloom.operators import patterns as pt
from motifloom.operators import static_dictionaries as sd

MODES = [
    Config(),
    Config(selection="optimal"),
    Config(selection="beam"),
    Config(selection="ilp"),
    Config(selection="semantic"),
    Config(discovery="suffix-array"),
    Config(discovery="bpe"),
    Config(discovery="bpe-extended"),
    Config(fuzzy=True),
    Config(length_tokens=False),
    Config(prune_subsumed=False),
    Config(regions=True, importance=True),
    Config(pool=1),
]


def sequences():
    rng = random.Random(7)
    yield from ([], ["a"], ["a", "b"], ["a"] * 20, list("abcde") * 5, list("xyz"))
    for _ in range(40):
        yield [rng.choice("abcde") for _ in range(rng.randrange(60))]
    for _ in range(10):
        base = [f"w{rng.randrange(30)}" for _ in range(12)]
        out = []
        for _ in range(8):
            w = list(base)
            w[rng.randrange(12)] = f"v{rng.randrange(9)}"
            out += w
        yield out


@pytest.mark.parametrize("config", MODES, ids=str)
def test_round_trip_and_never_longer(config):
    for tokens in sequences():
        c = codec.encode(tokens, config)
        assert codec.decode(c.stream, config) == tokens
        assert len(c.stream) <= len(tokens)
        assert not (set(c.entries) & set(tokens))


def test_other_tokens():
    rng = random.Random(11)
    for _ in range(40):
        tokens = [rng.randrange(8) for _ in range(rng.randrange(50))]
        assert codec.decode(codec.encode(tokens).stream) == tokens


def test_known_ratios():
    plain = Config(selection="optimal", hierarchical=False, length_tokens=False)
    assert codec.encode(list("abcd") * 4, plain).ratio <= 0.85
    assert codec.encode(list("xyz"), plain).ratio <= 1.0


def test_arithmetic():
    assert [ar.pays(n, k) for n, k in ((2, 4), (2, 5), (3, 2), (3, 3), (8, 2), (1, 99))] == [False, True, False, True, True, False]
    for n, k, e in itertools.product(range(2, 12), range(1, 12), (0, 1)):
        assert ar.pays(n, k, e) == (n * k > 1 + n + k + e) == (ar.savings(n, k, e) > 0)
        assert ar.pays(n, ar.least_count(n, e), e) or ar.raw_savings(n, int(ar.least_count(n, e)), e) == 0
        assert ar.marginal(n, k, e) == ar.savings(n, k + 1, e) - ar.savings(n, k, e)
    assert ar.density(4, 2) == pytest.approx(0.95)


@pytest.mark.parametrize(
    ("stream", "want"),
    [
        ("<Dict> <MT_1> <Len:2> a b <MT_2> <Len:2> <MT_1> c </Dict> <MT_2>", "a b c"),
        ("<StaticDict:policy-python-v1> <Dict> </Dict> <SD_0>", "def evaluate(self,"),
        ("<Dict> <MT_1> <Len:3> a b c </Dict> <MT_1> <Patch> <Idx:1> x </Patch>", "a x c"),
        ("a b c", "a b c"),
        ("", ""),
    ],
)
def test_decoding(stream, want):
    assert codec.decode(stream.split()) == want.split()


@pytest.mark.parametrize(
    ("stream", "said"),
    [
        ("<Dict> <MT_1> <Len:1> a <MT_1> <Len:1> b </Dict> <MT_1>", "Duplicate meta-token"),
        ("<Dict> a b </Dict> a", "missing meta-token"),
        ("<Dict> <MT_1> <Len:0> </Dict> a", "Empty dictionary entry"),
        ("<Dict> <MT_1> <Len:1> a", "missing dictionary end delimiter"),
        ("<Dict> <MT_1> <Len:x> a </Dict> a", "Invalid length"),
        ("<Dict> <MT_1> <Len:9> a </Dict> a", "longer than the dictionary"),
        ("<Dict> <MT_1> <Len:1> <MT_2> <MT_2> <Len:1> <MT_1> </Dict> <MT_1>", "circle"),
        ("<Dict> <MT_1> <Len:2> a b </Dict> <MT_1> <Patch> <Idx:5> x </Patch>", "outside"),
        ("<Dict> <MT_1> <Len:2> a b </Dict> <MT_1> <Patch> <Idx:1> x", "missing end"),
        ("<StaticDict:none> <Dict> </Dict> a", "Unknown static dictionary"),
        ("<StaticDict:sql-v1> a", "without a dictionary"),
    ],
)
def test_malformed_streams(stream, said):
    with pytest.raises(ValueError, match=said):
        codec.decode(stream.split())


def test_reserved_tokens_are_refused():
    for t in ("<Dict>", "</Dict>", "<MT_3>", "<Len:3>", "<Patch>", "<Idx:1>", "<SD_0>", "<Slot>", "<StaticDict:x>"):
        with pytest.raises(ValueError, match="Reserved"):
            codec.encode(["a", t])


def test_settings():
    for bad in ({"min_length": 1}, {"max_length": 1}, {"pool": 0}, {"passes": 0}, {"selection": "x"}, {"discovery": "x"}, {"beam_width": 0}, {"static_confidence": 2.0}):
        with pytest.raises(ValueError):
            validate(Config(**bad))
    with pytest.warns(UserWarning):
        validate(Config(max_length=20))


def plain(tokens, config):
    """All patterns that pay, without anything clever."""
    out = {}
    for n in range(config.min_length, config.max_length + 1):
        for p in {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)}:
            own = pt.free([i for i in range(len(tokens) - n + 1) if tuple(tokens[i : i + n]) == p], n)
            if ar.pays(n, len(own), config.extra):
                out[p] = tuple(own)
    return out


def test_discovery_agrees_with_brute_force():
    for tokens in sequences():
        want = plain(tokens, Config())
        for found in (pt.ngrams(tokens), pt.by_suffixes(tokens), pt.chunked(tokens, Config(), 13)):
            assert {c.tokens: c.starts for c in found} == want


def test_suffix_array():
    rng = random.Random(3)
    for n in (0, 1, 2, 30, 200):
        tokens = [rng.choice("abc") for _ in range(n)]
        order, shared = pt.suffix_array(tokens)
        assert order.tolist() == sorted(range(n), key=lambda i: tokens[i:])
        for r, k in enumerate(shared.tolist()):
            a, b = tokens[order[r] :], tokens[order[r + 1] :]
            assert a[:k] == b[:k] and (len(a) == k or len(b) == k or a[k] != b[k])
    order, shared = pt.suffix_array(list("banana"))
    assert set(pt.shared_intervals(shared)) == {(1, 2, 3), (0, 2, 1), (4, 5, 2)}


def test_merged_pairs_are_of_the_original():
    for tokens in sequences():
        for c in [*pt.merged_pairs(tokens), *pt.grown_pairs(tokens)]:
            assert all(tuple(tokens[s : s + c.length]) == c.tokens for s in c.starts)
    assert pt.merged_pairs(list("ababababababab"))[0].tokens == ("a", "b")


def test_fuzzy_patches():
    tokens = "a b c d e a b c x e a b c d e a y c d e".split()
    c = max(pt.fuzzy(tokens, Config(max_length=5)), key=lambda c: c.length)
    for s in c.starts:
        own = list(c.tokens)
        for i, t in c.patches.get(s, ()):
            own[i] = t
        assert own == tokens[s : s + c.length]
    with pytest.raises(ValueError):
        pt.fuzzy([1, 2])


def test_syntax():
    source = "def f(x):\n    return g(x, 1)\n\n\ndef h(x):\n    return g(x, 1)\n\n\ny = g(x, 1) + g(x, 1)\n"
    words, found = pt.by_syntax(source, Config(max_length=6))
    assert any(" ".join(c.tokens) == "g ( x , 1 )" and len(c.starts) == 4 for c in found)
    assert all(tuple(words[s : s + c.length]) == c.tokens for c in found for s in c.starts)
    assert pt.by_syntax("def (", Config()) == ([], [])


def score(chosen, extra=1):
    counts = {}
    for o in chosen:
        counts[o.pattern] = counts.get(o.pattern, 0) + 1
    return sum(ar.savings(len(p), k, extra) for p, k in counts.items())


def test_selections_are_valid_and_the_exact_one_is_best():
    rng = random.Random(23)
    for _ in range(40):
        tokens = [rng.choice("xyzw") for _ in range(rng.randrange(5, 26))]
        config = Config(max_length=5)
        found = select.stretches(pt.ngrams(tokens, config))
        got = {}
        for name, way in {"greedy": select.greedy, "optimal": select.optimal, "beam": select.beam, "ilp": select.integer_program}.items():
            chosen = way(found, config)
            assert all(a.end <= b.start for a, b in itertools.pairwise(chosen))
            counts = {o.pattern: sum(x.pattern == o.pattern for x in chosen) for o in chosen}
            assert all(ar.pays(len(p), k) for p, k in counts.items())
            got[name] = score(chosen)
        if len({o.pattern for o in found}) <= config.ilp_patterns:
            assert got["ilp"] == max(got.values())
            if len(found) <= 12:
                best = max(score(s) for k in range(len(found) + 1) for s in itertools.combinations(found, k) if all(a.end <= b.start or b.end <= a.start for a, b in itertools.combinations(s, 2)))
                assert got["ilp"] == best


def test_unknown_selection():
    with pytest.raises(ValueError):
        select.select(list("ababababab"), pt.ngrams(list("ababababab")), Config(selection="none"))


def test_semantic_factors():
    tokens = list("abcdabceabcf")
    found = [pt.Candidate(tuple("abc"), (0, 4, 8)), pt.Candidate(("d",), (3,))]
    same = select.context_factors(tokens, found, Config(), lambda texts: [[1.0, 0.0]] * len(texts))
    assert same[tuple("abc")] == pytest.approx(1.5) and same[("d",)] == 1.0
    apart = select.context_factors(tokens, found, Config(), lambda texts: np.eye(len(texts)).tolist())
    assert apart[tuple("abc")] == pytest.approx(0.5)

    def broken(texts):
        raise RuntimeError

    assert select.context_factors(tokens, found, Config(), broken)[tuple("abc")] == 1.0


def test_subsumption():
    tokens = list("abcabcabcabcxabyabzabwab")
    found = pt.ngrams(tokens)
    kept = {c.tokens: c.starts for c in pt.without_subsumed(found)}
    assert set(kept) <= {c.tokens for c in found}
    for c in found:
        for s in kept.get(c.tokens, ()):
            assert s in c.starts
    ranked = pt.by_own_value(found)
    assert [s for _, s in ranked] == sorted((s for _, s in ranked), reverse=True)


def test_templates():
    tokens = " ".join(f"the user {n} logged in from {m} at noon" for n, m in zip("abcdefgh", "stuvwxyz")).split()
    config = Config(max_length=9)
    assert any(t.slots == 2 for t in templates.discover(tokens, config))
    assert all(t.slots == 1 for t in templates.discover_single(tokens, config))
    for tokens in [tokens, *sequences()]:
        stream = templates.encode(tokens, config)
        assert templates.decode(stream, config) == tokens and len(stream) <= len(tokens)
    t = templates.Template(("a", templates.Slot(0), "b"), ((0, (("x",),)), (3, (("y", "z"),))))
    assert templates.framed(t) == "a {0} b" and t.original() == 7 and t.uses() == 9
    assert templates.filled(t.frame, [["q"]]) == ["a", "q", "b"]
    assert templates.parse_instance(["<SlotVal>", "x"], 0, 1) is None


def test_regions():
    tokens = "[SYSTEM] be kind [USER] hi ``` x = 1 ``` bye { a".split()
    found = regions.regions_of(tokens)
    assert [r.kind for r in found] == ["system", "user", "code", "unknown", "data"]
    assert found[0].start == 0 and found[-1].end == len(tokens)
    assert all(a.end == b.start for a, b in itertools.pairwise(found))
    assert [r.kind for r in regions.by_share(list("abcdefghij"))] == ["system", "user"]
    adjusted = regions.by_region([pt.Candidate(("be",), (1, 4))], found)
    assert adjusted[0].priority == -1
    assert sum(regions.totals(found).values()) == len(tokens)


def test_importance():
    found = [pt.Candidate(("a", "b"), (0, 4, 8)), pt.Candidate(("c", "d", "e", "f"), (90,))]
    scores = importance.composite(list(range(100)), found)
    assert all(0 <= s <= 1 for s in scores)
    assert importance.prioritised(found, [0.0, 1.0])[0].priority == 5
    assert importance.prioritised(found, [0.0]) == found
    assert importance.unimportant(found, [0.1, 0.9]) == found[:1]


def test_static_dictionaries(tmp_path):
    tokens = "return False x return True rule.user == user".split()
    config = Config(static_id="policy-python-v1")
    c = codec.encode(tokens, config)
    assert c.static_id == "policy-python-v1" and codec.decode(c.stream, config) == tokens and len(c.stream) <= len(tokens)
    sd.save("own", {"<SD_0>": ("p", "q", "r")}, str(tmp_path / "own.json"))
    assert sd.load(str(tmp_path / "own.json")) == "own" and sd.applied(list("xpqr"), "own") == ["x", "<SD_0>"]
    with pytest.raises(ValueError):
        sd.entries("none")
    code = ("def f ( self ) : return self " * 6).split()
    assert sd.chosen(code, Config(static_auto=True, static_confidence=0.5)) == "policy-python-v1"


def test_flips_reach_what_a_whole_search_does():
    """Local improvement by groups against the same over the whole sequence, with every pattern tried."""
    rng = random.Random(31)
    for _ in range(40):
        words = [rng.choice("abcd") for _ in range(rng.randrange(20, 70))]
        config = Config(selection="ilp", ilp_patterns=0)
        found = select.stretches(pt.ngrams(words, config))
        patterns = sorted({o.pattern for o in found}, key=lambda p: (-len(p), repr(p)))

        def value(chosen):
            used = Counter(o.pattern for o in chosen)
            return sum(ar.savings(len(p), n, 1) for p, n in used.items() if ar.pays(len(p), n, 1))

        def answer(own):
            chosen = select._heaviest([o for o in found if o.pattern in own], lambda o: o.length - 1)
            used = Counter(o.pattern for o in chosen)
            return [o for o in chosen if ar.pays(o.length, used[o.pattern], 1)]

        best = max((select.greedy(found, config), select.optimal(found, config), select.beam(found, config)), key=value)
        own, again = frozenset(o.pattern for o in best), True
        while again:
            again = False
            for p in patterns:
                other = answer(own ^ {p})
                if value(other) > value(best) + 1e-9:
                    best, own, again = other, frozenset(o.pattern for o in other), True
        got = select.integer_program(found, config) if found else []
        assert value(got) == value(best) and all(a.end <= b.start for a, b in zip(got, got[1:]))


def test_greedy_and_optimal_against_brute_force():
    """Greedy by trying every stretch in order; optimal by trying every set of stretches."""
    rng = random.Random(32)
    for _ in range(60):
        words = [rng.choice("abc") for _ in range(rng.randrange(8, 26))]
        config = Config()
        found = select.stretches(pt.without_subsumed(pt.ngrams(words, config), config))
        left = list(found)
        while True:
            taken = []
            for o in sorted(left, key=lambda o: (-(o.length - 1) / o.length, o.start, o.length)):
                if all(o.end <= t.start or t.end <= o.start for t in taken):
                    taken.append(o)
            used = Counter(o.pattern for o in taken)
            poor = {p for p, n in used.items() if len(p) * n <= 2 + len(p) + n}
            if not poor:
                break
            left = [o for o in left if o.pattern not in poor]
        assert select.greedy(found, config) == sorted(taken, key=lambda o: o.start)
        if 0 < len(found) <= 12:
            weight = {o: rng.choice((0, 1, 2.5, 4)) for o in found}
            sets = (c for k in range(len(found) + 1) for c in itertools.combinations(found, k) if all(a.end <= b.start for a, b in itertools.pairwise(sorted(c, key=lambda o: o.start))))
            assert sum(map(weight.get, select._heaviest(found, weight.get))) == max(sum(map(weight.get, c)) for c in sets)
