"""Choosing, among stretches that overlap, those to replace."""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Sequence
from itertools import combinations
from math import inf
from operator import itemgetter
from typing import NamedTuple

from motifloom.config import Config
from motifloom.functions.arithmetic import density, least_count, marginal, pays, savings

from .patterns import Candidate, Patch, Token, free

ROUNDS = 10
_rank = itemgetter(0, 1)


class Stretch(NamedTuple):
    """A place where a pattern may be replaced."""

    start: int
    length: int
    pattern: tuple[Token, ...]
    priority: int = 0
    patches: tuple[Patch, ...] = ()

    @property
    def end(self) -> int:
        return self.start + self.length


def stretches(candidates: Sequence[Candidate]) -> list[Stretch]:
    """Every start of every candidate, by end and start."""
    out = [Stretch(s, c.length, c.tokens, c.priority, tuple(c.patches.get(s, ()))) for c in candidates for s in c.starts]
    return sorted(out, key=lambda o: (o.end, o.start))


def _refined(found: Sequence[Stretch], config: Config, choose: Callable[[list[Stretch]], list[Stretch]]) -> list[Stretch]:
    """``choose`` again without the patterns that were chosen too rarely to pay, until all pay."""
    count = Counter(o.pattern for o in found)
    left = [o for o in found if count[o.pattern] >= least_count(o.length, config.extra)]
    chosen: list[Stretch] = []
    for _ in range(ROUNDS):
        chosen = choose(left) if left else []
        count = Counter(o.pattern for o in chosen)
        poor = {p for p, n in count.items() if not pays(len(p), n, config.extra)}
        if not poor:
            break
        left = [o for o in left if o.pattern not in poor]
        chosen = [o for o in chosen if o.pattern not in poor]
    return sorted(chosen, key=lambda o: o.start)


def greedy(found: Sequence[Stretch], config: Config) -> list[Stretch]:
    """The densest first, whatever still fits."""

    def choose(left: list[Stretch]) -> list[Stretch]:
        taken = bytearray(max(o.end for o in left))
        kept = []
        for o in sorted(left, key=lambda o: (-density(o.length, o.priority), o.start, o.length)):
            # nothing longer than the stretch lies inside it, but ends of others may
            if not taken.count(1, o.start, o.end):
                taken[o.start : o.end] = b"\x01" * o.length
                kept.append(o)
        return kept

    return _refined(found, config, choose)


def _heaviest(left: list[Stretch], weight: Callable[[Stretch], float]) -> list[Stretch]:
    """Non-overlapping stretches of the largest total weight; a stretch is left out where it adds nothing."""
    ends = [o.end for o in left]
    best, take, before = [0.0], [], []
    for i, o in enumerate(left):
        p = bisect_right(ends, o.start, 0, i)
        w = weight(o) + best[p]
        take.append(w > best[i])
        before.append(p)
        best.append(max(w, best[i]))
    chosen, i = [], len(left)
    while i:
        if take[i - 1]:
            chosen.append(left[i - 1])
            i = before[i - 1]
        else:
            i -= 1
    return chosen[::-1]


def _shares(left: list[Stretch], config: Config) -> dict[tuple[Token, ...], float]:
    """By pattern: what one stretch saves, its share of the dictionary entry taken off."""
    starts: dict[tuple[Token, ...], list[int]] = defaultdict(list)
    for o in left:
        starts[o.pattern].append(o.start)
    return {p: max(0.0, len(p) - 1 - (1 + len(p) + config.extra) / len(free(sorted(s), len(p)))) for p, s in starts.items()}


def optimal(found: Sequence[Stretch], config: Config, factor: Callable[[tuple[Token, ...]], float] = lambda _: 1.0) -> list[Stretch]:
    """Weighted interval scheduling by what each stretch saves, times a factor of its pattern."""

    def choose(left: list[Stretch]) -> list[Stretch]:
        share = _shares(left, config)
        return _heaviest(left, lambda o: share[o.pattern] * factor(o.pattern) + 0.5 * o.priority)

    return _refined(found, config, choose)


def beam(found: Sequence[Stretch], config: Config) -> list[Stretch]:
    """Left to right, keeping the best ``beam_width`` partial choices.

    The counts of a choice are copied once it is kept, not for every choice
    that is tried.
    """

    def choose(left: list[Stretch]) -> list[Stretch]:
        number: dict[tuple[Token, ...], int] = {}
        for o in left:
            number.setdefault(o.pattern, len(number))
        #: by length, what the next stretch adds after so many
        steps = {n: [marginal(n, k, config.extra) for k in range(least_count(n, config.extra) + 1)] for n in {o.length for o in left}}
        # score below 0, end, counts, linked list of choices, by score and end
        states: list[tuple] = [(0.0, -1, array("i", bytes(array("i").itemsize * len(number))), None)]
        for o in sorted(left, key=lambda o: (o.start, o.length)):
            own, step, bonus, end = number[o.pattern], steps[o.length], 0.5 * o.priority, o.end
            # of equals the earlier stay, so what isn't better than the last of a full beam is lost
            bar = states[-1][:2] if len(states) == config.beam_width else (inf, inf)
            more = []
            for state in states:
                if o.start >= state[1]:
                    n = state[2][own]
                    key = (state[0] - ((step[n] if n < len(step) else o.length - 1) + bonus), end)
                    if key < bar:
                        more.append((*key, None, state))
            if more:
                best = sorted([*states, *more], key=_rank)[: config.beam_width]
                for i, (score, until, counts, chain) in enumerate(best):
                    if counts is None:
                        counts = chain[2][:]
                        counts[own] += 1
                        best[i] = (score, until, counts, (o, chain[3]))
                states = best
        chain, out = states[0][3], []
        while chain:
            out.append(chain[0])
            chain = chain[1]
        return out[::-1]

    return _refined(found, config, choose)


def integer_program(found: Sequence[Stretch], config: Config) -> list[Stretch]:
    """Stretches and dictionary entries of the largest total saving.

    For a given set of patterns the best stretches are found by interval
    scheduling, so only the sets are searched: all of them up to
    ``ilp_patterns`` patterns, beyond that by adding and removing single
    patterns, any of them, from the best other answer until nothing improves.
    """
    count = Counter(o.pattern for o in found)
    left = [o for o in found if count[o.pattern] >= least_count(o.length, config.extra)]
    patterns = sorted({o.pattern for o in left}, key=lambda p: (-len(p), repr(p)))

    def value(chosen: list[Stretch]) -> float:
        used = Counter(o.pattern for o in chosen)
        return sum(savings(len(p), n, config.extra) for p, n in used.items()) + sum(0.1 * o.priority for o in chosen)

    def answer(own: frozenset) -> list[Stretch]:
        inside = [o for o in left if o.pattern in own]
        chosen = _heaviest(inside, lambda o: o.length - 1 + 0.1 * o.priority)
        used = Counter(o.pattern for o in chosen)
        return [o for o in chosen if pays(o.length, used[o.pattern], config.extra)]

    best: list[Stretch] = []
    if len(patterns) <= config.ilp_patterns:
        for k in range(1, len(patterns) + 1):
            for own in combinations(patterns, k):
                best = max(best, answer(frozenset(own)), key=value)
        return best
    best = max((greedy(found, config), optimal(found, config), beam(found, config)), key=value)
    return _Flips(left, best, config).improved(patterns, value(best)) or best


class _Flips:
    """The best stretches for a set of patterns, kept by groups of stretches that touch no others.

    Adding or removing a pattern changes only the groups that it has a stretch
    in, so all patterns can be tried, however long the sequence.
    """

    def __init__(self, left: Sequence[Stretch], best: Sequence[Stretch], config: Config) -> None:
        self.config, self.own = config, {o.pattern for o in best}
        self.groups: list[list[Stretch]] = []
        self.of: dict[tuple[Token, ...], list[int]] = defaultdict(list)
        end = -1
        for o in sorted(left, key=lambda o: o.start):
            if o.start >= end:
                self.groups.append([])
            end = max(end, o.end)
            self.groups[-1].append(o)
            if self.of[o.pattern][-1:] != [len(self.groups) - 1]:
                self.of[o.pattern].append(len(self.groups) - 1)
        for g in self.groups:
            g.sort(key=lambda o: (o.end, o.start))
        self.chosen = [self.solved(g, self.own) for g in range(len(self.groups))]
        self.count, self.priority = Counter(), Counter()
        for g in self.chosen:
            self.counted(g, 1, self.count, self.priority)

    def solved(self, group: int, own: set) -> list[Stretch]:
        return _heaviest([o for o in self.groups[group] if o.pattern in own], lambda o: o.length - 1 + 0.1 * o.priority)

    @staticmethod
    def counted(chosen: Sequence[Stretch], sign: int, count: Counter, priority: Counter) -> None:
        for o in chosen:
            count[o.pattern] += sign
            priority[o.pattern] += sign * o.priority

    def worth(self, p: tuple[Token, ...], n: int, priority: int) -> float:
        return savings(len(p), n, self.config.extra) + 0.1 * priority if pays(len(p), n, self.config.extra) else 0.0

    def improved(self, patterns: Sequence[tuple[Token, ...]], most: float) -> list[Stretch]:
        """The stretches after flips of single patterns until none improves on ``most``; nothing if none does."""
        total = sum(self.worth(p, n, self.priority[p]) for p, n in self.count.items())
        best: list[Stretch] = []
        again = True
        while again:
            again = False
            for p in patterns:
                other = {g: self.solved(g, self.own ^ {p}) for g in self.of[p]}
                count, priority = Counter(), Counter()
                for g, chosen in other.items():
                    self.counted(self.chosen[g], -1, count, priority)
                    self.counted(chosen, 1, count, priority)
                now = total + sum(self.worth(q, self.count[q] + n, self.priority[q] + priority[q]) - self.worth(q, self.count[q], self.priority[q]) for q, n in count.items())
                if now <= most + 1e-9:
                    continue
                most, again = now, True
                self.moved(other)
                kept = {q for q, n in self.count.items() if pays(len(q), n, self.config.extra)}
                best = [o for g in self.chosen for o in g if o.pattern in kept]
                # what doesn't pay leaves the set, and its places are free for others
                dropped = {g for q, n in self.count.items() if n and q not in kept for g in self.of[q]}
                self.own = kept
                self.moved({g: self.solved(g, kept) for g in dropped})
                total = sum(self.worth(q, n, self.priority[q]) for q, n in self.count.items())
        return sorted(best, key=lambda o: o.start)

    def moved(self, other: dict[int, list[Stretch]]) -> None:
        for g, chosen in other.items():
            self.counted(self.chosen[g], -1, self.count, self.priority)
            self.counted(chosen, 1, self.count, self.priority)
            self.chosen[g] = chosen


def context_factors(tokens: Sequence[Token], candidates: Sequence[Candidate], config: Config, embed: Callable[[list[str]], Sequence[Sequence[float]]], most: int = 32) -> dict[tuple[Token, ...], float]:
    """By pattern: above 1 if the places around it are alike, below if they differ."""
    factors: dict[tuple[Token, ...], float] = {}
    for c in candidates:
        if len(c.starts) < 2:
            factors[c.tokens] = 1.0
            continue
        around = [" ".join(map(str, tokens[max(0, s - config.context) : s + c.length + config.context])) for s in c.starts[:most]]
        try:
            vectors = embed(around)
        except (RuntimeError, ValueError, OSError):
            factors[c.tokens] = 1.0
            continue
        alike = mean_cosine(vectors)
        over = alike - config.similarity
        factors[c.tokens] = max(0.1, 1 + 0.5 * over / (1 - config.similarity) if over >= 0 else 1 + config.diversity_penalty * over / config.similarity)
    return factors


def mean_cosine(vectors: Sequence[Sequence[float]]) -> float:
    """Mean cosine over all pairs; 1 for fewer than two vectors."""
    import numpy as np

    v = np.asarray(vectors, dtype=np.float64)
    if len(v) < 2:
        return 1.0
    size = np.linalg.norm(v, axis=1, keepdims=True)
    u = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
    g = u @ u.T
    return float((g.sum() - np.trace(g)) / (len(v) * (len(v) - 1)))


def select(tokens: Sequence[Token], candidates: Sequence[Candidate], config: Config, embed: Callable | None = None) -> list[Stretch]:
    """The stretches to replace, by start."""
    found = stretches(candidates)
    if not found:
        return []
    if config.selection == "semantic" and embed is not None:
        factor = context_factors(tokens, candidates, config, embed)
        return optimal(found, config, lambda p: factor.get(p, 1.0))
    ways = {"greedy": greedy, "optimal": optimal, "beam": beam, "ilp": integer_program, "semantic": optimal}
    if config.selection not in ways:
        raise ValueError(f"no such selection: {config.selection}")
    return ways[config.selection](found, config)
