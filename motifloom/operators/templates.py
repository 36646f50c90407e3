"""Templates: patterns with slots whose contents vary."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import groupby

from motifloom.config import Config

from . import patterns as pt
from .codec import is_meta, number_in, require_free
from .patterns import Token, free


@dataclass(frozen=True)
class Slot:
    """A place in a frame that holds 1 to ``width`` tokens."""

    index: int
    width: int = 1


@dataclass(frozen=True)
class Template:
    """A frame of tokens and slots, and (start, contents of each slot) of its instances."""

    frame: tuple[Token | Slot, ...]
    instances: tuple[tuple[int, tuple[tuple[Token, ...], ...]], ...]

    @property
    def slots(self) -> int:
        return sum(isinstance(f, Slot) for f in self.frame)

    @property
    def fixed(self) -> int:
        return len(self.frame) - self.slots

    @property
    def fixed_share(self) -> float:
        return self.fixed / len(self.frame) if self.frame else 0.0

    def original(self) -> int:
        """Tokens that the instances take up."""
        return sum(self.fixed + sum(map(len, values)) for _, values in self.instances)

    def entry(self, extra: int = 1) -> int:
        """Tokens of the dictionary entry."""
        return 1 + extra + len(self.frame)

    def uses(self) -> int:
        """Tokens of the instances when coded: the name, and each slot's contents between two marks."""
        return sum(1 + sum(2 + len(v) for v in values) for _, values in self.instances)

    def savings(self, extra: int = 1) -> int:
        return self.original() - self.entry(extra) - self.uses()

    def spans(self) -> Iterator[tuple[int, int]]:
        for start, values in self.instances:
            yield start, start + self.fixed + sum(map(len, values))


def framed(template: Template) -> str:
    """The frame as text, slots as {0}, {1} and so on."""
    return " ".join(f"{{{f.index}}}" if isinstance(f, Slot) else str(f) for f in template.frame)


def filled(frame: Sequence[Token | Slot], values: Sequence[Sequence[Token]]) -> list[Token]:
    """The tokens of one instance."""
    return [t for f in frame for t in (values[f.index] if isinstance(f, Slot) else (f,))]


def _aligned(rows: list[tuple[int, tuple[Token, ...]]], config: Config) -> Template | None:
    """The template of windows of one length: columns that all share are fixed, runs of others are slots."""
    columns = list(zip(*(w for _, w in rows)))
    runs = [(fixed, [i for i, _ in own]) for fixed, own in groupby(enumerate(len(set(c)) == 1 for c in columns), key=lambda x: x[1])]
    holes = [own for fixed, own in runs if not fixed]
    if not holes or len(holes) > config.template_slots or max(map(len, holes)) > config.slot_length:
        return None
    frame: list[Token | Slot] = []
    for fixed, own in runs:
        frame += [columns[i][0] for i in own] if fixed else [Slot(sum(isinstance(f, Slot) for f in frame), len(own))]
    found = Template(tuple(frame), tuple((p, tuple(tuple(w[i] for i in own) for own in holes)) for p, w in rows))
    return found if found.fixed_share >= config.frame_ratio and found.savings(config.extra) > 0 else None


def _best(found: list[Template], config: Config) -> list[Template]:
    """By savings, without those of which more than half the starts are taken."""
    taken: set[int] = set()
    out = []
    for t in sorted(found, key=lambda t: -t.savings(config.extra)):
        own = {p for p, _ in t.instances}
        if len(own & taken) * 2 <= len(own):
            out.append(t)
            taken |= own
    return out


def discover(tokens: Sequence[Token], config: Config = Config()) -> list[Template]:
    """Templates of several slots, among windows that share every third token."""
    found: list[Template] = []
    codes = pt.encode(tokens)
    for size in range(min(config.max_length, len(tokens)), config.min_length - 1, -1):
        prints: dict[tuple, list[int]] = defaultdict(list)
        for i in pt.recurring(codes, size, range(0, size, 3), config.template_instances):
            prints[tuple(tokens[i : i + size : 3])].append(i)
        used: set[int] = set()
        for places in prints.values():
            own = [p for p in free(places, size) if p not in used] if len(places) >= config.template_instances else []
            if len(own) < config.template_instances:
                continue
            rows = [(p, tuple(tokens[p : p + size])) for p in own]
            if len({w for _, w in rows}) > 1:
                used.update(own)
                if (t := _aligned(rows, config)) is not None:
                    found.append(t)
    return _best(found, config) if len(tokens) >= 2 * config.min_length else []


def discover_single(tokens: Sequence[Token], config: Config = Config()) -> list[Template]:
    """Templates with exactly one slot of one token, at any place."""
    found: list[Template] = []
    codes = pt.encode(tokens)
    for size in range(min(config.max_length, len(tokens)), config.min_length - 1, -1):
        for hole in range(size):
            around: dict[tuple, list[int]] = defaultdict(list)
            for i in pt.recurring(codes, size, (o for o in range(size) if o != hole), config.template_instances):
                around[(*tokens[i : i + hole], *tokens[i + hole + 1 : i + size])].append(i)
            for rest, places in around.items():
                if len(places) < config.template_instances:
                    continue
                own = free(places, size)
                if len(own) < config.template_instances or len({tokens[p + hole] for p in own}) < 2:
                    continue
                t = Template((*rest[:hole], Slot(0), *rest[hole:]), tuple((p, ((tokens[p + hole],),)) for p in own))
                if t.savings(config.extra) > 0:
                    found.append(t)
    return _best(found, config) if len(tokens) >= 2 * config.min_length else []


def encode(tokens: Sequence[Token], config: Config = Config()) -> list[Token]:
    """The sequence with instances of templates replaced; as it is where that is no shorter."""
    require_free(tokens, config)
    taken = bytearray(len(tokens))
    placed: dict[int, tuple[int, list[Token]]] = {}
    entries: dict[Token, list[Token]] = {}
    for t in [*discover(tokens, config), *discover_single(tokens, config)]:
        open_ = tuple(i for i, (a, b) in zip(t.instances, t.spans()) if not taken.count(1, a, b))
        own = Template(t.frame, open_)
        if len(entries) >= config.pool or not open_ or own.savings(config.extra) <= 0:
            continue
        name = f"{config.meta[0]}{len(entries)}{config.meta[1]}"
        entries[name] = [config.slot if isinstance(f, Slot) else f for f in t.frame]
        for (start, values), (a, b) in zip(open_, own.spans()):
            taken[a:b] = b"\x01" * (b - a)
            placed[start] = (b, [name, *(x for v in values for x in (config.slot_value[0], *v, config.slot_value[1]))])
    out: list[Token] = [config.dictionary[0]]
    for name, frame in entries.items():
        out += [name, *([f"{config.length_mark[0]}{len(frame)}{config.length_mark[1]}"] if config.length_tokens else []), *frame]
    out.append(config.dictionary[1])
    at = 0
    while at < len(tokens):
        to, coded = placed.get(at, (at + 1, [tokens[at]]))
        out += coded
        at = to
    return out if entries and len(out) < len(tokens) else list(tokens)


def parse_instance(body: Sequence[Token], at: int, slots: int, config: Config = Config()) -> tuple[list[list[Token]], int] | None:
    """Contents of the slots that follow a name, and where they end; None where they are malformed."""
    values: list[list[Token]] = []
    for _ in range(slots):
        if at >= len(body) or body[at] != config.slot_value[0] or config.slot_value[1] not in body[at:]:
            return None
        end = body.index(config.slot_value[1], at)
        values.append(list(body[at + 1 : end]))
        at = end + 1
    return values, at


def decode(stream: Sequence[Token], config: Config = Config()) -> list[Token]:
    """The sequence that a stream with templates stands for."""
    rest = list(stream)
    if not rest or rest[0] != config.dictionary[0]:
        return rest
    if config.dictionary[1] not in rest:
        raise ValueError("Malformed stream: missing dictionary end delimiter")
    end, at = rest.index(config.dictionary[1]), 1
    frames: dict[Token, list[Token]] = {}
    while at < end:
        name = rest[at]
        if not is_meta(name, config):
            raise ValueError("Malformed dictionary: missing meta-token")
        at += 1
        if config.length_tokens:
            n = number_in(rest[at], config.length_mark, "length")
            at += 1
        else:
            n = next((k for k in range(at, end) if is_meta(rest[k], config)), end) - at
        frames[name] = rest[at : at + n]
        at += n
    out: list[Token] = []
    at = end + 1
    while at < len(rest):
        frame: list[Token] | None = frames.get(rest[at])
        at += 1
        if frame is None:
            out.append(rest[at - 1])
            continue
        parsed = parse_instance(rest, at, frame.count(config.slot), config)
        if parsed is None:
            raise ValueError("Malformed template instance")
        values, at = parsed
        parts: Iterator[list[Token]] = iter(values)
        out += [t for f in frame for t in (next(parts) if f == config.slot else [f])]
    return out


def replacements(templates: Mapping[Token, Template]) -> dict[int, tuple[int, Token]]:
    """By start: (length, name) of each instance."""
    return {a: (b - a, name) for name, t in templates.items() for a, b in t.spans()}
