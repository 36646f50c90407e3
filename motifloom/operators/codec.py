"""Coding one token sequence as a dictionary and a shorter body, and back."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from motifloom.config import Config
from motifloom.functions.arithmetic import raw_savings

from . import patterns as pt
from . import static_dictionaries as sd
from .patterns import Candidate, Token
from .select import Stretch, select

Sequences = dict[Token, tuple[Token, ...]]


@dataclass
class Coded:
    """A coded sequence: ``entries`` in the order in which they may be expanded."""

    original: list[Token]
    body: list[Token]
    entries: Sequences
    stream: list[Token]
    static_id: str | None = None
    depth: dict[Token, int] = field(default_factory=dict)
    candidates: int = 0

    @property
    def ratio(self) -> float:
        return len(self.stream) / len(self.original) if self.original else 1.0


def _within(token: Token, mark: tuple[str, str]) -> str | None:
    """What stands between the marks, if the token has both."""
    if isinstance(token, str) and token.startswith(mark[0]) and token.endswith(mark[1]) and len(token) >= len(mark[0]) + len(mark[1]):
        return token[len(mark[0]) : len(token) - len(mark[1])]
    return None


def is_meta(token: Token, config: Config = Config()) -> bool:
    return _within(token, config.meta) is not None


def number_in(token: Token, mark: tuple[str, str], what: str) -> int:
    """The number in a marked token; ValueError if it holds none."""
    inside = _within(token, mark)
    if inside is None or not (inside.isascii() and inside.isdigit()):
        raise ValueError(f"Invalid {what} token: {token!r}")
    return int(inside)


def is_reserved(token: Token, config: Config = Config()) -> bool:
    """Whether a token would be taken for part of the coding."""
    if not isinstance(token, str):
        return False
    fixed = (*config.dictionary, *config.patch, config.slot, *config.slot_value)
    spans = [config.meta, config.index_mark, config.static_mark, sd.MARK, *([config.length_mark] if config.length_tokens else [])]
    return token in fixed or any(_within(token, m) is not None for m in spans)


def require_free(tokens: Iterable[Token], config: Config = Config()) -> None:
    """ValueError if any token is reserved."""
    fixed = (*config.dictionary, *config.patch, config.slot, *config.slot_value)
    # of the distinct tokens, only those that begin like a reserved one need a look
    begins = tuple({*fixed, config.meta[0], config.index_mark[0], config.static_mark[0], config.length_mark[0], sd.MARK[0]})
    for t in set(tokens):
        if isinstance(t, str) and t.startswith(begins) and is_reserved(t, config):
            raise ValueError(f"Reserved token in the input: {t!r}")


def body_with(tokens: Sequence[Token], chosen: Sequence[Stretch], names: Mapping[tuple, Token], config: Config) -> list[Token]:
    """The sequence with each chosen stretch replaced by its name and its patches."""
    out: list[Token] = []
    at = 0
    for o in chosen:
        if o.pattern not in names:
            continue
        out += tokens[at : o.start]
        out.append(names[o.pattern])
        if o.patches:
            out.append(config.patch[0])
            for i, t in o.patches:
                out += [f"{config.index_mark[0]}{i}{config.index_mark[1]}", t]
            out.append(config.patch[1])
        at = o.end
    return [*out, *tokens[at:]]


def ordered(entries: Sequences) -> Sequences:
    """Entries so that each comes after those it uses; ValueError if they use each other in a circle."""
    out: Sequences = {}
    state: dict[Token, int] = {}
    for root in entries:
        stack = [root]
        while stack:
            name = stack[-1]
            if state.get(name) == 2:
                stack.pop()
                continue
            waiting = [t for t in entries[name] if t in entries and state.get(t) != 2]
            if state.get(name) == 1 and waiting:
                raise ValueError("The dictionary uses itself in a circle")
            state[name] = 1
            if waiting:
                if any(state.get(t) == 1 for t in waiting):
                    raise ValueError("The dictionary uses itself in a circle")
                stack += dict.fromkeys(waiting)
            else:
                state[name] = 2
                out[name] = entries[name]
                stack.pop()
    return out


def dictionary_tokens(entries: Sequences, config: Config) -> list[Token]:
    """The dictionary as it stands at the head of a stream."""
    out: list[Token] = [config.dictionary[0]]
    for name, sequence in ordered(entries).items():
        out.append(name)
        if config.length_tokens:
            out.append(f"{config.length_mark[0]}{len(sequence)}{config.length_mark[1]}")
        out += sequence
    return [*out, config.dictionary[1]]


def serialised(entries: Sequences, body: Sequence[Token], config: Config, static_id: str | None = None) -> list[Token]:
    """Static marker, dictionary and body; the body alone if there is neither."""
    if not entries and static_id is None:
        return list(body)
    head = [f"{config.static_mark[0]}{static_id}{config.static_mark[1]}"] if static_id is not None else []
    return [*head, *dictionary_tokens(entries, config), *body]


def discovered(tokens: Sequence[Token], config: Config, barrier: Callable[[Token], bool] | None) -> list[Candidate]:
    """Candidates of the configured kind; where there are barriers, windows."""
    if config.discovery == "suffix-array" and barrier is None:
        exact = pt.by_suffixes(tokens, config)
    elif config.discovery == "bpe" and barrier is None:
        exact = [c for c in pt.merged_pairs(tokens, config) if c.length <= config.max_length]
    elif config.discovery == "bpe-extended" and barrier is None:
        exact = pt.grown_pairs(tokens, config)
    else:
        exact = pt.ngrams(tokens, config, barrier)
    if config.fuzzy and all(isinstance(t, str) for t in tokens):
        return [*pt.fuzzy(tokens, config, lambda t: (barrier is not None and barrier(t)) or is_meta(t, config)), *exact]
    return exact


def _worth_patching(candidates: list[Candidate], config: Config) -> list[Candidate]:
    """Without the stretches whose patches cost what they save."""
    out = []
    for c in candidates:
        starts = tuple(s for s in c.starts if not c.patches.get(s) or 3 + 2 * len(c.patches[s]) < c.length)
        out.append(Candidate(c.tokens, starts, c.priority, {s: c.patches[s] for s in starts if c.patches.get(s)}))
    return [c for c in out if c.starts]


def encode(tokens: Sequence[Token], config: Config = Config(), extra: Sequence[Candidate] = (), embed: Callable | None = None) -> Coded:
    """``tokens`` coded; as they are where no coding is shorter.

    ``extra`` candidates (of syntax, or from a cache) join those found in the
    first pass.  Names are given in the order of first use and never twice, so
    entries of later passes may use earlier ones and none is overwritten.
    """
    tokens = list(tokens)
    require_free(tokens, config)
    static_id = sd.chosen(tokens, config)
    body: list[Token] = sd.applied(tokens, static_id) if static_id else tokens
    entries: Sequences = {}
    depth: dict[Token, int] = {}
    seen = 0

    for level in range(1, (config.passes if config.hierarchical else 1) + 1):
        blocked = _patch_interior(body, config)
        work = [("barrier", i) if i in blocked else t for i, t in enumerate(body)] if blocked else body
        inside = (lambda t: isinstance(t, tuple) and t[:1] == ("barrier",)) if blocked else None
        found = discovered(work, config, inside) if level == 1 or not config.fuzzy else pt.ngrams(work, config, inside)
        if level == 1:
            found = [*extra, *found]
        found = _worth_patching(pt.deduplicated(found), config)
        if level == 1:
            found = adjusted(tokens, body, found, config, embed)
        if config.prune_subsumed:
            found = pt.without_subsumed(found, config)
        seen += len(found)
        chosen = select(work, found, config, embed)
        # a patch makes a stretch dearer than the choice reckoned
        used = Counter(o.pattern for o in chosen)
        cost = Counter()
        for o in chosen:
            cost[o.pattern] += 2 + 2 * len(o.patches) if o.patches else 0
        names: dict[tuple, Token] = {}
        for o in chosen:
            if o.pattern not in names and len(entries) + len(names) < config.pool and raw_savings(o.length, used[o.pattern], config.extra) > cost[o.pattern]:
                names[o.pattern] = f"{config.meta[0]}{len(entries) + len(names)}{config.meta[1]}"
        if not names:
            break
        shorter = body_with(body, chosen, names, config)
        growth = sum(1 + len(p) + config.extra for p in names)
        saved = len(body) - len(shorter)
        poor = level > 1 and (saved < config.least_gain * len(body) or saved < config.gain_over_cost * growth)
        if poor and config.discard_poor_pass:
            break
        body = shorter
        for p, n in names.items():
            entries[n] = p
            depth[n] = level
        if poor:
            break
    stream = serialised(entries, body, config, static_id)
    if config.templates:
        from . import templates

        framed = templates.encode(tokens, config)
        if len(framed) < min(len(stream), len(tokens)):
            return Coded(tokens, framed, {}, framed, candidates=seen)
    if len(stream) > len(tokens):
        return Coded(tokens, tokens, {}, tokens, candidates=seen)
    result = Coded(tokens, body, ordered(entries), stream, static_id, depth, seen)
    if config.verify and decode(stream, config) != tokens:
        raise ValueError("The coding does not decode to its input")
    return result


def _patch_interior(body: Sequence[Token], config: Config) -> set[int]:
    """Places in patch blocks, with the name before each: no pattern may reach into one."""
    out: set[int] = set()
    if config.patch[0] not in body:
        return out
    opened = False
    for i, t in enumerate(body):
        if t == config.patch[0]:
            opened = True
            out.add(i - 1)
        if opened:
            out.add(i)
        if t == config.patch[1]:
            opened = False
    return out


def adjusted(tokens: Sequence[Token], body: Sequence[Token], found: list[Candidate], config: Config, embed: Callable | None) -> list[Candidate]:
    """Priorities by region and importance, where the configuration asks for them."""
    from . import importance, regions

    if config.regions:
        found = regions.by_region(found, regions.regions_of(body))
    if config.importance:
        scores = importance.composite(body, found, embed)
        keep = [i for i, s in enumerate(scores) if s < config.importance_threshold]
        found = importance.prioritised([found[i] for i in keep], [scores[i] for i in keep], config.importance_weight)
    return found


def parsed(stream: Sequence[Token], config: Config = Config()) -> tuple[str | None, Sequences, list[Token]]:
    """Static id, dictionary and body of a stream; ValueError where it is malformed."""
    rest = list(stream)
    static_id = _within(rest[0], config.static_mark) if rest else None
    if static_id is not None:
        rest = rest[1:]
    if not rest or rest[0] != config.dictionary[0]:
        if static_id is not None:
            raise ValueError("Static dictionary without a dictionary section")
        return None, {}, rest
    if config.dictionary[1] not in rest:
        raise ValueError("Malformed stream: missing dictionary end delimiter")
    end = rest.index(config.dictionary[1])
    head, body = rest[1:end], rest[end + 1 :]
    entries: Sequences = {}
    at = 0
    while at < len(head):
        name = head[at]
        if not is_meta(name, config):
            raise ValueError("Malformed dictionary: missing meta-token")
        if name in entries:
            raise ValueError(f"Duplicate meta-token in the dictionary: {name}")
        at += 1
        if config.length_tokens:
            if at >= len(head):
                raise ValueError("Malformed dictionary: missing length token")
            n = number_in(head[at], config.length_mark, "length")
            at += 1
            if at + n > len(head):
                raise ValueError("Dictionary entry longer than the dictionary")
            sequence = tuple(head[at : at + n])
            at += n
        else:
            # without lengths, a name that was not yet defined begins the next entry
            until = at
            while until < len(head) and not (is_meta(head[until], config) and head[until] not in entries):
                until += 1
            sequence = tuple(head[at:until])
            at = until
        if not sequence:
            raise ValueError(f"Empty dictionary entry: {name}")
        entries[name] = sequence
    return static_id, entries, body


def decode(stream: Sequence[Token], config: Config = Config()) -> list[Token]:
    """The sequence that a stream stands for."""
    if config.templates and config.slot in stream:
        from . import templates

        return templates.decode(stream, config)
    static_id, entries, body = parsed(stream, config)
    return decode_with(body, entries, config, static_id)


def decode_with(body: Sequence[Token], entries: Mapping[Token, Sequence[Token]], config: Config = Config(), static_id: str | None = None) -> list[Token]:
    """The sequence that a body stands for, with the dictionary apart from it."""
    known: dict[Token, Sequence[Token]] = {}
    if static_id is not None:
        known |= sd.entries(static_id)
        if clash := known.keys() & entries.keys():
            raise ValueError(f"Static and dynamic entries of one name: {sorted(clash)}")
    known |= entries
    whole: dict[Token, list[Token]] = {}
    for name, sequence in ordered({k: tuple(v) for k, v in known.items()}).items():
        whole[name] = [t for part in sequence for t in (whole[part] if part in whole else [part])]
    if not known:
        return list(body)
    out: list[Token] = []
    at = 0
    while at < len(body):
        token = body[at]
        at += 1
        if token not in whole:
            if is_meta(token, config):
                raise ValueError(f"Unknown meta-token: {token}")
            out.append(token)
            continue
        own = list(whole[token])
        if at < len(body) and body[at] == config.patch[0]:
            at += 1
            while at < len(body) and body[at] != config.patch[1]:
                i = number_in(body[at], config.index_mark, "patch index")
                if i >= len(own) or at + 1 >= len(body):
                    raise ValueError(f"Patch outside of its pattern: {i}")
                own[i] = body[at + 1]
                at += 2
            if at >= len(body):
                raise ValueError("Malformed patch: missing end delimiter")
            at += 1
        out += own
    return out


def metrics(coded: Coded) -> dict[str, float | int | dict[int, int]]:
    """What the coding achieved."""
    n, uses = len(coded.original), Counter(coded.body)
    entries = coded.entries
    levels: dict[Token, int] = {}
    for name, sequence in entries.items():
        levels[name] = 1 + max((levels.get(t, 0) for t in sequence), default=0)
    head = len(coded.stream) - len(coded.body)
    return {
        "compression_amount": 1 - coded.ratio if n else 0.0,
        "compression_ratio": coded.ratio,
        "effective_savings": n - len(coded.stream),
        "candidates": coded.candidates,
        "patterns_used": len(entries),
        "avg_pattern_length": sum(map(len, entries.values())) / len(entries) if entries else 0.0,
        "avg_pattern_frequency": sum(uses[m] for m in entries) / len(entries) if entries else 0.0,
        "dictionary_overhead": head / len(coded.stream) if coded.stream else 0.0,
        "depth_utilization": dict(Counter(levels.values())),
    }
