"""Finding repeated patterns in one token sequence.

These functions see one document each; :mod:`motifloom.operators.corpus` runs
them over whole tables.  Tokens may be any hashable values.
"""

from __future__ import annotations

import ast
import io
import tokenize
from collections import Counter, defaultdict
from collections.abc import Callable, Hashable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np

from motifloom.config import Config
from motifloom.functions.arithmetic import pays, raw_savings

Token = Hashable
Patch = tuple[int, Token]


@dataclass(frozen=True)
class Candidate:
    """A pattern and where it begins; ``patches`` by start where a stretch differs from it."""

    tokens: tuple[Token, ...]
    starts: tuple[int, ...]
    priority: int = 0
    patches: Mapping[int, tuple[Patch, ...]] = field(default_factory=dict)

    @property
    def length(self) -> int:
        return len(self.tokens)


def free(starts: Iterable[int], length: int) -> list[int]:
    """Ascending starts taken from left to right without overlap."""
    kept, until = [], -1
    for s in starts:
        if s >= until:
            kept.append(s)
            until = s + length
    return kept


def encode(tokens: Sequence[Token], barrier: Callable[[Token], bool] | None = None) -> np.ndarray:
    """A number for each distinct token; -1 for those that no pattern may hold."""
    known: dict[Token, int] = {}
    codes = np.fromiter((known.setdefault(t, len(known)) for t in tokens), dtype=np.int64, count=len(tokens))
    if barrier:
        bad = np.array([barrier(t) for t in known], dtype=bool)
        if bad.any():
            codes = np.where(bad[codes], -1, codes)
    return codes


def windows(codes: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, starts, group) of all windows that occur more than once, by group and start.

    A window of n tokens can repeat only where both its windows of n - 1 do, so
    each length is named by pairs of names of the length before and what occurs
    once is dropped for good.
    """
    name = codes
    for length in range(1, longest + 1):
        if length > 1:
            if len(name) < 2:
                return
            left, right = name[:-1], name[1:]
            base = int(name.max()) + 1
            name = np.where((left >= 0) & (right >= 0), left * base + right, -1)
        at = np.flatnonzero(name >= 0)
        if not len(at):
            return
        order = at[np.argsort(name[at], kind="stable")]
        key = name[order]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(fresh) - 1
        again = np.bincount(group)[group] > 1
        name = np.full(len(name), -1, dtype=np.int64)
        name[order[again]] = group[again]
        if not again.any():
            return
        yield length, order[again], group[again]


def recurring(codes: np.ndarray, size: int, offsets: Iterable[int], least: int) -> list[int]:
    """Ascending starts of the windows whose tokens at ``offsets`` occur together at least so often.

    By 64-bit hashes: another start may slip in, none is left out.
    """
    n = len(codes) - size + 1
    if n < least:
        return []
    key = np.zeros(n, dtype=np.uint64)
    for o in offsets:
        key = (key + codes[o : o + n].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
    return np.flatnonzero(count[which] >= least).tolist()


def ngrams(tokens: Sequence[Token], config: Config = Config(), barrier: Callable[[Token], bool] | None = None) -> list[Candidate]:
    """All patterns that pay, the longest first, then by first start."""
    out: list[Candidate] = []
    for length, starts, group in windows(encode(tokens, barrier), config.max_length):
        if length < config.min_length:
            continue
        cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(cut, len(group)))
        tight = np.zeros(len(cut), dtype=bool)
        close = np.flatnonzero((np.diff(starts) < length) & (np.diff(group) == 0))
        tight[np.searchsorted(cut, close, side="right") - 1] = True
        enough = np.flatnonzero(size * (length - 1) > 1 + length + config.extra)
        for g in enough.tolist():
            own = starts[cut[g] : cut[g] + size[g]].tolist()
            if tight[g]:
                own = free(own, length)
                if not pays(length, len(own), config.extra):
                    continue
            out.append(Candidate(tuple(tokens[own[0] : own[0] + length]), tuple(own)))
    out.sort(key=lambda c: (-c.length, c.starts[0]))
    return out


def chunked(tokens: Sequence[Token], config: Config, chunk: int) -> list[Candidate]:
    """``ngrams``, found in chunks that overlap by one token less than the longest pattern and put together."""
    own: dict[tuple[Token, ...], set[int]] = defaultdict(set)
    for low in range(0, len(tokens), chunk):
        part = tokens[low : low + chunk + config.max_length - 1]
        for length in range(config.min_length, config.max_length + 1):
            for i in range(min(chunk, len(part) - length + 1)):
                own[tuple(part[i : i + length])].add(low + i)
    kept = ((p, free(sorted(s), len(p))) for p, s in own.items())
    return sorted((Candidate(p, tuple(s)) for p, s in kept if pays(len(p), len(s), config.extra)), key=lambda c: (-c.length, c.starts[0]))


def suffix_array(tokens: Sequence[Token]) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the prefix each shares with the next (one less)."""
    n = len(tokens)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    alphabet = sorted(set(tokens), key=lambda t: (type(t).__name__, repr(t)))
    place = {t: i for i, t in enumerate(alphabet)}
    rank = np.fromiter((place[t] for t in tokens), dtype=np.int64, count=n)
    step = 1
    while True:
        after = np.concatenate([rank[step:], np.full(min(step, n), -1)])[:n]
        order = np.lexsort((after, rank))
        new = np.zeros(n, dtype=np.int64)
        new[order[1:]] = np.cumsum((np.diff(rank[order]) != 0) | (np.diff(after[order]) != 0))
        rank = new
        if rank.max() == n - 1 or step >= n:
            break
        step *= 2
    shared, k = np.zeros(max(0, n - 1), dtype=np.int64), 0
    for i, r in enumerate(rank.tolist()):
        if r == n - 1:
            k = 0
            continue
        j = int(order[r + 1])
        while i + k < n and j + k < n and tokens[i + k] == tokens[j + k]:
            k += 1
        shared[r] = k
        k = max(0, k - 1)
    return order, shared


def shared_intervals(shared: Sequence[int]) -> list[tuple[int, int, int]]:
    """(first, last, prefix): ranks whose suffixes share a prefix, each maximal; inner ones before outer ones."""
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = [(0, 0)]
    for i, value in enumerate([*map(int, shared), 0]):
        low = i
        while stack and stack[-1][1] > value:
            low, k = stack.pop()
            out.append((low, i, k))
        if not stack or stack[-1][1] < value:
            stack.append((low, value))
    return out


def by_suffixes(tokens: Sequence[Token], config: Config = Config()) -> list[Candidate]:
    """The patterns of ``ngrams``, read off the intervals of the suffix array.

    Every start of a pattern is taken, from whatever interval it comes.
    """
    order, shared = suffix_array(tokens)
    places: dict[tuple[Token, ...], set[int]] = defaultdict(set)
    for first, last, prefix in shared_intervals(shared):
        inside = order[first : last + 1].tolist()
        for length in range(config.min_length, min(prefix, config.max_length) + 1):
            places[tuple(tokens[inside[0] : inside[0] + length])].update(inside)
    kept = ((p, free(sorted(s), len(p))) for p, s in places.items())
    return sorted((Candidate(p, tuple(s)) for p, s in kept if pays(len(p), len(s), config.extra)), key=lambda c: (-c.length, c.starts[0]))


def _pair_starts(items: Sequence[Token], a: Token, b: Token) -> list[int]:
    return free((i for i in range(len(items) - 1) if items[i] == a and items[i + 1] == b), 2)


def best_pair(items: Sequence[Token], extra: int, considered: int = 100) -> tuple[tuple[Token, Token], list[int]] | None:
    """Of the pairs that occur most, the one whose merging saves most; the earlier in that order of equals."""
    best, most = None, 0
    for pair, raw in Counter(zip(items, items[1:])).most_common(considered):
        if raw_savings(2, raw, extra) <= most:
            break  # nothing after it can save more
        starts = _pair_starts(items, *pair)
        gain = raw_savings(2, len(starts), extra)
        if gain > most:
            best, most = (pair, starts), gain
    return best


def merged_pairs(tokens: Sequence[Token], config: Config = Config(), rounds: int = 100) -> list[Candidate]:
    """Merging the best pair again and again: a candidate of the original tokens for each merge."""
    items: list[Token] = list(tokens)
    spans = [(i, i + 1) for i in range(len(tokens))]
    out: list[Candidate] = []
    for n in range(rounds):
        if (found := best_pair(items, config.extra)) is None:
            break
        _, starts = found
        whole = [(spans[s][0], spans[s + 1][1]) for s in starts]
        out.append(Candidate(tuple(tokens[whole[0][0] : whole[0][1]]), tuple(a for a, _ in whole), 1))
        mark = ("merged", n)
        for s, span in zip(reversed(starts), reversed(whole)):
            items[s : s + 2], spans[s : s + 2] = [mark], [span]
    return out


def grown_pairs(tokens: Sequence[Token], config: Config = Config()) -> list[Candidate]:
    """Pairs that pay, each grown by a token to either side while that saves strictly more."""
    first: dict[Token, list[int]] = defaultdict(list)
    for i, t in enumerate(tokens):
        first[t].append(i)
    n, out = len(tokens), {}

    def everywhere(pattern: tuple[Token, ...]) -> list[int]:
        k = len(pattern)
        return [i for i in first[pattern[0]] if tuple(tokens[i : i + k]) == pattern]

    def grown(pair: tuple[Token, Token]) -> Candidate:
        pattern, starts = pair, free(everywhere(pair), 2)
        gain = raw_savings(2, len(starts), config.extra)
        while len(pattern) < config.max_length:
            longer: dict[tuple[Token, ...], list[int]] = {}
            everything, k = everywhere(pattern), len(pattern)
            for i in everything:
                if i + k < n:
                    longer.setdefault((*pattern, tokens[i + k]), []).append(i)
            for i in everything:
                if i:
                    longer.setdefault((tokens[i - 1], *pattern), []).append(i - 1)
            chosen = None
            for p, at in longer.items():
                own = free(sorted(set(at)), k + 1)
                if (g := raw_savings(k + 1, len(own), config.extra)) > gain:
                    gain, chosen = g, (p, own)
            if chosen is None:
                break
            pattern, starts = chosen
        return Candidate(pattern, tuple(starts), 1)

    for pair, raw in Counter(zip(tokens, tokens[1:])).items():
        if pays(2, raw, config.extra) and pays(2, len(own := free(everywhere(pair), 2)), config.extra):
            c = grown(pair)
            if c.tokens in out:
                c = Candidate(pair, tuple(own), 1)
            out.setdefault(c.tokens, c)
    return sorted(out.values(), key=lambda c: (-c.length, -len(c.starts)))


def patched_savings(length: int, patches: Iterable[Sequence[Patch]], extra: int = 1) -> int:
    """What stretches with so many patches save together."""
    every = list(patches)
    return length * len(every) - (1 + length + extra) - sum(3 + 2 * len(p) if p else 1 for p in every)


def fuzzy(tokens: Sequence[Token], config: Config = Config(), barrier: Callable[[Token], bool] | None = None) -> list[Candidate]:
    """Patterns whose stretches differ in at most ``max_diff`` tokens, among those with equal tokens at even places."""
    if not all(isinstance(t, str) for t in tokens):
        raise ValueError("differences are looked for in text tokens only")
    blocked, codes = [barrier is not None and barrier(t) for t in tokens], encode(tokens)
    out: list[Candidate] = []
    for length in range(min(config.max_length, len(tokens)), config.min_length - 1, -1):
        places: dict[tuple, list[int]] = {}
        for i in recurring(codes, length, range(0, length, 2), 2):
            if not any(blocked[i : i + length]):
                places.setdefault(tuple(tokens[i : i + length]), []).append(i)
        buckets: dict[tuple, list[tuple]] = {}
        for gram in places:
            buckets.setdefault(gram[::2], []).append(gram)
        for bucket in buckets.values():
            for members in _alike(bucket, config.max_diff):
                centre = max(members, key=lambda g: len(places[g]))
                changes = {g: tuple((i, b) for i, (a, b) in enumerate(zip(centre, g)) if a != b) for g in members}
                where = sorted((p, changes[g]) for g in members for p in places[g])
                if patched_savings(length, (c for _, c in where), config.extra) > 0:
                    out.append(Candidate(centre, tuple(p for p, _ in where), 1, {p: c for p, c in where if c}))
    return out


def _alike(bucket: Sequence[tuple], most: int) -> Iterator[list[tuple]]:
    """Groups of two or more: the first gram of those left, with all that differ from it in at most ``most`` tokens.

    The grams are equal at even places.  Those that are equal at the odd places
    but ``most`` of them share a key, and who shares one is near, so each key's
    grams are looked at once.
    """
    if len(bucket) < 2:
        return
    odd = [g[1::2] for g in bucket]
    places = range(len(odd[0]))
    if most >= len(places):
        yield list(bucket)
        return
    keys: dict[tuple, list[int]] = {}
    ways = list(combinations(places, len(places) - most))
    for i, o in enumerate(odd):
        for w, way in enumerate(ways):
            keys.setdefault((w, *[o[k] for k in way]), []).append(i)
    if len(keys) == len(ways) * len(bucket):
        return
    gone = bytearray(len(bucket))
    for i, o in enumerate(odd):
        if gone[i]:
            continue
        near = {j for w, way in enumerate(ways) for j in keys.pop((w, *[o[k] for k in way]), ()) if not gone[j]}
        for j in near:
            gone[j] = 1
        if len(near) > 1:
            yield [bucket[j] for j in sorted(near)]


def source_tokens(source: str) -> list[tuple[str, tuple[int, int], tuple[int, int]]]:
    """(token, begin, end) of Python source, in lines and columns; line breaks and the like left out."""
    left_out = {tokenize.ENCODING, tokenize.NL, tokenize.NEWLINE, tokenize.ENDMARKER}
    return [(t.string, t.start, t.end) for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type not in left_out]


def _shape(node: ast.AST) -> tuple:
    if isinstance(node, ast.Name | ast.Constant | ast.arg):
        return (type(node).__name__,)
    return (type(node).__name__, *[_shape(c) for c in ast.iter_child_nodes(node)])


def by_syntax(source: str, config: Config = Config()) -> tuple[list[str], list[Candidate]]:
    """The tokens of Python source, and the patterns that are whole syntax nodes of a shape that recurs; none if it doesn't parse."""
    try:
        tree, listed = ast.parse(source), source_tokens(source)
    except (SyntaxError, tokenize.TokenError, ValueError, MemoryError, RecursionError):
        return [], []  # the last two: nested too deeply for the parser
    words = [t for t, _, _ in listed]
    shapes: dict[tuple, set[tuple[int, int]]] = defaultdict(set)
    lines = source.splitlines()
    for node in ast.walk(tree):
        if getattr(node, "end_lineno", None) is None:
            continue
        # columns of the tree are bytes, those of tokens characters
        begin, end = ((row, len(lines[row - 1].encode()[:col].decode(errors="ignore"))) for row, col in ((node.lineno, node.col_offset), (node.end_lineno, node.end_col_offset)))
        inside = [i for i, (_, a, b) in enumerate(listed) if a >= begin and b <= end]
        if inside and config.min_length <= len(inside) <= config.max_length:
            shapes[_shape(node)].add((inside[0], inside[-1] + 1))
    grouped: dict[tuple[str, ...], set[int]] = defaultdict(set)
    for spans in shapes.values():
        if len(spans) > 1:
            for a, b in spans:
                grouped[tuple(words[a:b])].add(a)
    kept = ((p, free(sorted(s), len(p))) for p, s in grouped.items())
    found = [Candidate(p, tuple(s), 2) for p, s in kept if pays(len(p), len(s), config.extra)]
    return words, sorted(found, key=lambda c: (-c.length, c.starts[0]))


def deduplicated(candidates: Iterable[Candidate]) -> list[Candidate]:
    """One candidate a pattern: all starts, all patches, the highest priority."""
    grouped: dict[tuple[Token, ...], list[Candidate]] = {}
    for c in candidates:
        grouped.setdefault(c.tokens, []).append(c)
    out = []
    for pattern, group in grouped.items():
        if len(group) == 1:
            out.append(group[0])
            continue
        patches = {p: x for c in group for p, x in c.patches.items()}
        starts = free(sorted({s for c in group for s in c.starts}), len(pattern))
        out.append(Candidate(pattern, tuple(starts), max(c.priority for c in group), {p: x for p, x in patches.items() if p in set(starts)}))
    return out


def containment(candidates: Sequence[Candidate]) -> dict[int, list[int]]:
    """By candidate: the longer ones that contain its pattern."""
    named = {c.tokens: i for i, c in enumerate(candidates)}
    lengths = sorted({c.length for c in candidates})
    out: dict[int, list[int]] = {i: [] for i in range(len(candidates))}
    for j, c in enumerate(candidates):
        inner = {c.tokens[o : o + n] for n in lengths if n < c.length for o in range(c.length - n + 1)}
        for gram in inner:
            if (i := named.get(gram)) is not None:
                out[i].append(j)
    return out


def covered_starts(candidates: Sequence[Candidate], i: int, longer: Iterable[int]) -> set[int]:
    """Starts of candidate i that lie in stretches of the longer ones."""
    own, n = candidates[i].tokens, candidates[i].length
    return {s + o for j in longer for o in range(candidates[j].length - n + 1) if candidates[j].tokens[o : o + n] == own for s in candidates[j].starts}


def without_subsumed(candidates: Sequence[Candidate], config: Config = Config()) -> list[Candidate]:
    """Candidates that no longer one contains, and of the others the starts of their own, where enough of them pay."""
    inside, out = containment(candidates), []
    for i, c in enumerate(candidates):
        if not inside[i]:
            out.append(c)
            continue
        hidden = covered_starts(candidates, i, inside[i])
        own = [s for s in c.starts if s not in hidden]
        if len(own) >= config.independent and pays(c.length, len(own), config.extra):
            out.append(Candidate(c.tokens, tuple(own), c.priority, c.patches))
    return out


def own_values(candidates: Sequence[Candidate], config: Config = Config()) -> list[tuple[Candidate, int, float]]:
    """Each candidate with how many of its starts longer ones cover, and what it saves beyond those."""
    inside = containment(candidates)
    holds = Counter(j for longer in inside.values() for j in longer)
    out = []
    for i, c in enumerate(candidates):
        base = max(0, raw_savings(c.length, len(c.starts), config.extra))
        covered = len(covered_starts(candidates, i, inside[i]) & set(c.starts)) if inside[i] and c.starts else 0
        share = covered / len(c.starts) if covered else 0.0
        out.append((c, covered, base - 0.8 * base * share + (0.0 if inside[i] else 0.1 * base) + 0.5 * holds[i]))
    return out


def by_own_value(candidates: Sequence[Candidate], config: Config = Config()) -> list[tuple[Candidate, float]]:
    """Candidates by what they save beyond the longer ones that contain them."""
    return sorted(((c, score) for c, _, score in own_values(candidates, config)), key=lambda x: -x[1])
