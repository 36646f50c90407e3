"""Kernels that do the same in fewer steps: against the plain way, with the steps counted."""

import heapq
import random

from motifloom.config import Config
from motifloom.operators import patterns as pt
from motifloom.operators import select


def texts():
    r = random.Random(3)
    return [[r.choice("abcdefgh"[:k]) for _ in range(n)] for k in (1, 2, 3, 5, 8) for n in (2, 9, 60, 250)]


def plain_beam(found, config):
    def choose(left):
        states = [(0.0, -1, {}, ())]
        for o in sorted(left, key=lambda o: (o.start, o.length)):
            more = [(s + select.marginal(o.length, n.get(o.pattern, 0), config.extra) + 0.5 * o.priority, o.end, {**n, o.pattern: n.get(o.pattern, 0) + 1}, (*c, o)) for s, e, n, c in states if o.start >= e]
            states = heapq.nsmallest(config.beam_width, [*states, *more], key=lambda s: (-s[0], s[1]))
        return list(states[0][3])

    return select._refined(found, config, choose)


def test_beam_is_the_plain_one():
    taken = 0
    for width in (1, 3, 8):
        config = Config(beam_width=width)
        for words in texts():
            found = select.stretches([pt.Candidate(c.tokens, c.starts, i % 3) for i, c in enumerate(pt.ngrams(words, config))])
            assert (chosen := select.beam(found, config)) == plain_beam(found, config)
            taken += len(chosen)
    assert taken


def test_beam_reckons_what_a_stretch_adds_once_a_length(monkeypatch):
    found = select.stretches(pt.ngrams(texts()[-1] * 4, Config()))
    calls, plain = [], select.marginal
    monkeypatch.setattr(select, "marginal", lambda *x: (calls.append(x), plain(*x))[1])
    select.beam(found, Config())
    # in each of up to ten rounds, for each length and the counts that don't pay yet
    assert len(calls) <= select.ROUNDS * sum(select.least_count(n) + 1 for n in range(2, 9))


def plain_groups(bucket, most):
    waiting = list(bucket)
    while waiting:
        members = [g for g in waiting if sum(a != b for a, b in zip(waiting[0], g)) <= most]
        if len(members) > 1:
            yield members
        waiting = [g for g in waiting if g not in members]


def test_alike_grams_are_the_plain_ones():
    r = random.Random(4)
    for length in range(2, 10):
        for most in range(4):
            for size in (2, 5, 60):
                bucket = list({tuple(r.choice("xyz") if k % 2 else "e" for k in range(length)) for _ in range(size)})
                assert list(pt._alike(bucket, most)) == list(plain_groups(bucket, most))


def test_fuzzy_patterns_compare_no_pairs():
    compared = []

    class Word(str):
        __hash__ = str.__hash__

        def __ne__(self, other):
            compared.append(1)
            return str.__ne__(self, other)

    words = [Word(t) for i in range(300) for t in ("a", f"x{i}", "b", f"y{i}", "c")]
    pt.fuzzy(words, Config(min_length=5, max_length=5))
    assert len(compared) < 5 * len(words)
