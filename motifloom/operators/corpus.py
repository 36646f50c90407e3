"""The operators over tables of documents.

Whatever concerns one document alone runs in :meth:`mapInArrow` kernels: no
shuffle, memory bounded by an Arrow batch of texts (Spark's 10,000 rows or 64
MB), the longest document and ``BYTES`` of results, whatever the table's size.
What crosses documents (containment edges, shared dictionaries) is expressed
as joins and aggregates on pattern keys.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifloom.config import Config, validate
from motifloom.functions import arithmetic as ar
from motifloom.functions.tokens import free_starts, has_reserved, normal_text, tokens
from motifloom.sources.storage import settled

from . import codec, importance, templates
from . import patterns as pt
from .select import select

_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
FEW_BYTES = 128 << 20  #: a table of fewer is spread over the cores
ROWS = 50_000  #: of results that a kernel holds at most before it passes them on
BYTES = 8 << 20  #: of results that a kernel holds before it passes them on, whatever their number
_ITEM = 64  #: bytes of a token or a value, about


def spread(docs: DataFrame) -> DataFrame:
    """Tables of few bytes over all cores, since a file of one row group is read by one task; others as they are, without a shuffle.

    The plan alone depends on it, not the rows.  Where the plan can't be asked
    for its size (over Spark Connect), it stays as it is.
    """
    try:
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:
        return docs
    return docs.repartition(docs.sparkSession.sparkContext.defaultParallelism) if size < FEW_BYTES else docs


def per_document(docs: DataFrame, schema: str, work: Callable[[object, list[str]], Iterator[tuple]], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows that ``work(id, tokens)`` gives for each document; a null text has no tokens."""
    fields = [f.rsplit(" ", 1) for f in schema.split(", ")]
    arrow = pa.schema([(n, _TYPES[t]) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one string a document crosses to Python, not one a token
        texts = ((doc_id, value.as_py()) for batch in batches for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)))
        return _passed_on((row for doc_id, flat in texts for row in work(doc_id, flat.split(" ") if flat else [])), arrow)

    return spread(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))).select("doc_id", normal_text(F.col("text")).alias("text")).mapInArrow(run, schema)


def _passed_on(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of at most ``ROWS``, each ending once it holds ``BYTES``, so that a kernel's memory doesn't follow the rows of its task."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) * _ITEM if isinstance(v, list) else len(v) + _ITEM if isinstance(v, str) else _ITEM for v in row)
        if size >= BYTES or len(held) >= ROWS:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _pieces(lists: pa.Array) -> Iterator[list]:
    """An array of lists as Python lists, as many at a time as hold about ``BYTES``; one at least."""
    total = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) * _ITEM
    at = 0
    while at < len(lists):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BYTES, side="right")))
        yield from lists.slice(at, end - at).to_pylist()
        at = end


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_CANDIDATE = "doc_id bigint, pattern string, length bigint, n bigint, starts array<int>, priority int"


def _finder(find: Callable[[list[str], Config], list[pt.Candidate]], config: Config) -> Callable[[object, list[str]], Iterator[tuple]]:
    def work(doc_id: object, words: list[str]) -> Iterator[tuple]:
        for c in find(words, config):
            yield doc_id, " ".join(map(str, c.tokens)), c.length, len(c.starts), list(c.starts), c.priority

    return work


def candidates(docs: DataFrame, config: Config = Config(), kind: str = "window") -> DataFrame:
    """(doc_id, pattern, length, n, starts, priority): the patterns of each document that pay there.

    ``kind``: window, suffix-array, bpe, bpe-extended, fuzzy or syntax; a
    document without tokens has none.
    """
    ways = {"window": pt.ngrams, "suffix-array": pt.by_suffixes, "bpe": pt.merged_pairs, "bpe-extended": pt.grown_pairs, "fuzzy": pt.fuzzy}
    if kind == "syntax":
        source = docs.select("doc_id", F.array("text").alias("t"))
        return source.mapInArrow(_syntax(config), _CANDIDATE)
    return per_document(docs, _CANDIDATE, _finder(ways[kind], validate(config)))


def _syntax(config: Config) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    arrow = pa.schema([(n, _TYPES[t]) for n, t in (f.rsplit(" ", 1) for f in _CANDIDATE.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (x for batch in batches for x in zip(batch.column(0).to_pylist(), _pieces(batch.column(1))))
        found = ((doc_id, c) for doc_id, (text,) in texts for c in pt.by_syntax(text or "", config)[1])
        return _passed_on(((doc_id, " ".join(c.tokens), c.length, len(c.starts), list(c.starts), c.priority) for doc_id, c in found), arrow)

    return run


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(found: Column) -> Column:
    """Of windows (pattern, start), those whose pattern occurs more than once, in order."""

    def again(own: Column) -> Column:
        same = lambda x, k: F.get(own, k)["pattern"] == x["pattern"]
        return F.filter(own, lambda x, k: same(x, k - 1) | same(x, k + 1))

    return _let(F.sort_array(found), again)


def _pairs(words: Column) -> Column:
    """(pattern, start) of every window of two tokens."""
    first = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.transform(first, lambda t, i: F.struct(F.concat_ws(" ", t, F.get(words, i + 1)).alias("pattern"), i.alias("start")))


def _longer(found: Column, words: Column, length: int) -> Column:
    """Windows of a token more than ``found``, where both windows of ``length`` in them are found."""

    def grown(placed: Column) -> Column:
        both = F.filter(placed, lambda x, k: F.get(placed, k + 1)["start"] == x["start"] + 1)
        return F.transform(both, lambda x: F.struct(F.concat_ws(" ", x["pattern"], F.get(words, x["start"] + length)).alias("pattern"), x["start"].alias("start")))

    return _let(F.sort_array(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["pattern"].alias("pattern")))), grown)


def _grouped(found: Column, length: int, extra: int) -> Column:
    """(length, pattern, s) of windows in order: those that pay if none of their places overlap."""

    def cut(heads: Column) -> Column:
        spans = F.transform(heads, lambda h, j: F.struct(h.alias("at"), (F.coalesce(F.get(heads, j + 1), F.size(found)) - h).alias("raw")))
        enough = F.filter(spans, lambda x: ar.pays_column(F.lit(length), x["raw"], extra))
        return F.transform(enough, lambda x: F.struct(F.lit(length).alias("length"), F.get(found, x["at"])["pattern"].alias("pattern"), F.transform(F.slice(found, x["at"] + 1, x["raw"]), lambda y: y["start"]).alias("s")))

    fresh = lambda k: F.coalesce(F.get(found, k - 1)["pattern"] != F.get(found, k)["pattern"], F.lit(True))
    return _let(F.filter(F.transform(found, lambda x, k: k), fresh), cut)


def candidates_declared(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, pattern, length, n, starts) as ``candidates`` finds them, as one declarative plan; kept to check the kernel against.

    No shuffle and no sort of rows: the windows of a document are an array in
    its row, and only those that occur again grow by a token, so a task holds
    one document's windows and none goes to disk.
    """

    def found(words: Column, own: Column, length: int) -> Column:
        here = [_grouped(own, length, config.extra)] if length >= config.min_length else []
        if length == config.max_length:
            return here[0]
        return _let(_repeated(_longer(own, words, length)), lambda longer: F.concat(*here, found(words, longer, length + 1)))

    every = _let(tokens(F.col("text")), lambda w: _let(_repeated(_pairs(w)), lambda own: found(w, own, 2)))
    grouped = spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).select("doc_id", F.explode(every).alias("g")).select("doc_id", "g.*")
    kept = grouped.withColumn("starts", free_starts(F.col("s"), F.col("length")))
    return kept.select("doc_id", "pattern", F.col("length").cast("bigint").alias("length"), F.size("starts").cast("bigint").alias("n"), "starts").filter(ar.pays_column(F.col("length"), F.col("n"), config.extra))


def with_savings(found: DataFrame, config: Config = Config()) -> DataFrame:
    """``found`` with what each pattern saves, what one more stretch would, and the least count that pays."""
    length, n = F.col("length"), F.col("n")
    return found.withColumns({"savings": ar.savings_column(length, n, config.extra), "marginal": ar.marginal_column(length, n, config.extra), "least_count": ar.least_count_column(length, config.extra)})


def deduplicated(found: DataFrame) -> DataFrame:
    """One row a document and pattern: all starts of all stages without overlap, the highest priority."""
    merged = found.groupBy("doc_id", "pattern", "length").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("starts")))).alias("s"), F.max("priority").alias("priority"), F.count("*").alias("stages"))
    starts = F.when(F.col("stages") > 1, free_starts(F.col("s"), F.col("length"))).otherwise(F.col("s"))
    return merged.select("doc_id", "pattern", "length", F.size(starts).cast("bigint").alias("n"), starts.alias("starts"), "priority")


def _inner(found: DataFrame) -> DataFrame:
    """(doc_id, outer, shorter, offset): every proper part of every pattern, once for each place."""
    w = F.split("pattern", " ")
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.size(w) - 1), lambda k: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda o: F.struct(F.array_join(F.slice(w, o + 1, k), " ").alias("shorter"), o.alias("offset")))))
    return found.filter("length > 2").select("doc_id", F.col("pattern").alias("outer"), F.explode(parts).alias("p")).select("doc_id", "outer", "p.*")


def containment(found: DataFrame) -> DataFrame:
    """(doc_id, longer, shorter): which patterns contain which, by an equality join on the parts of the longer ones.

    ``found`` is computed once, into the shared folder, as it is read twice.
    """
    found = settled(found)
    return _contains(found)


def _contains(found: DataFrame) -> DataFrame:
    short = found.select("doc_id", F.col("pattern").alias("shorter"))
    return _inner(found).select("doc_id", F.col("outer").alias("longer"), "shorter").distinct().join(short, ["doc_id", "shorter"]).select("doc_id", "longer", "shorter")


def maximal(found: DataFrame) -> DataFrame:
    """Patterns that no other contains; ``found`` is computed once."""
    found = settled(found)
    return found.join(_inner(found).select("doc_id", F.col("shorter").alias("pattern")).distinct(), ["doc_id", "pattern"], "left_anti")


def _covered(found: DataFrame) -> DataFrame:
    """(doc_id, pattern, start): stretches of shorter patterns inside those of longer ones."""
    parts = _inner(found).join(found.select("doc_id", F.col("pattern").alias("outer"), "starts"), ["doc_id", "outer"])
    places = F.transform("starts", lambda s: s + F.col("offset"))
    return parts.select("doc_id", F.col("shorter").alias("pattern"), F.explode(places).alias("start")).distinct()


def without_subsumed(found: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, pattern, length, n): maximal patterns, and of others the starts outside longer ones where enough pay.

    For any table of candidates, which is computed once; :func:`pruned` does
    the same while it discovers, without a shuffle.
    """
    found = settled(found)
    inside = _inner(found).select("doc_id", F.col("shorter").alias("pattern")).distinct().withColumn("inner", F.lit(True))
    marked = found.join(inside, ["doc_id", "pattern"], "left")
    whole = marked.filter("inner is null").select("doc_id", "pattern", "length", "n")
    own = marked.filter("inner").select("doc_id", "pattern", "length", F.explode("starts").alias("start")).join(_covered(found), ["doc_id", "pattern", "start"], "left_anti")
    rest = own.groupBy("doc_id", "pattern", "length").agg(F.count("*").alias("n")).filter((F.col("n") >= config.independent) & ar.pays_column(F.col("length"), F.col("n"), config.extra))
    return whole.unionByName(rest)


def by_own_value(found: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, pattern, n, covered, score): what patterns save beyond the longer ones that contain them.

    For any table of candidates, which is computed once, as are its edges;
    :func:`own_values` does the same while it discovers, without a shuffle.
    """
    found = settled(found)
    edges = settled(_contains(found))
    holds = edges.groupBy("doc_id", F.col("longer").alias("pattern")).agg(F.count("*").alias("holds"))
    within = edges.select("doc_id", F.col("shorter").alias("pattern")).distinct().withColumn("inner", F.lit(True))
    starts = found.select("doc_id", "pattern", F.explode("starts").alias("start"))
    covered = starts.join(_covered(found), ["doc_id", "pattern", "start"], "left_semi").groupBy("doc_id", "pattern").agg(F.count("*").alias("covered"))
    rows = found.join(holds, ["doc_id", "pattern"], "left").join(within, ["doc_id", "pattern"], "left").join(covered, ["doc_id", "pattern"], "left").fillna(0, ["holds", "covered"])
    base = ar.savings_column(F.col("length"), F.col("n"), config.extra)
    score = base - base * F.col("covered") / F.col("n") * 0.8 + F.when(F.col("inner"), 0.0).otherwise(base * 0.1) + F.col("holds") * 0.5
    return rows.select("doc_id", "pattern", "n", "covered", F.round(score, 6).alias("score"))


def pruned(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, pattern, length, n) of each document's candidates without those that longer ones subsume; no shuffle."""

    def work(doc_id: object, words: list[str]) -> Iterator[tuple]:
        for c in pt.without_subsumed(pt.ngrams(words, config), config):
            yield doc_id, " ".join(c.tokens), c.length, len(c.starts)

    return per_document(docs, "doc_id bigint, pattern string, length bigint, n bigint", work)


def own_values(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, pattern, n, covered, score) of each document's candidates, as :func:`by_own_value` has them; no shuffle."""

    def work(doc_id: object, words: list[str]) -> Iterator[tuple]:
        for c, covered, score in pt.own_values(pt.ngrams(words, config), config):
            yield doc_id, " ".join(c.tokens), len(c.starts), covered, round(score, 6)

    return per_document(docs, "doc_id bigint, pattern string, n bigint, covered bigint, score double", work)


def coverage(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, pattern, coverage): the share of its document that a pattern takes up, 1 at most."""
    from motifloom.functions.tokens import token_count

    size = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), token_count(F.col("text")).alias("n_tokens"))
    return found.join(size, "doc_id").select("doc_id", "pattern", F.round(F.least(F.lit(1.0), F.col("n") * F.col("length") / F.col("n_tokens")), 6).alias("coverage"))


def importance_scores(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, pattern, positional, frequency, length_score, score, boost) of each pattern in its document."""
    from motifloom.functions.tokens import token_count

    size = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), token_count(F.col("text")).alias("n_tokens"))
    by = Window.partitionBy("doc_id")
    mean = F.aggregate("starts", F.lit(0).cast("bigint"), lambda a, x: a + x) / F.col("n")
    rows = found.join(size, "doc_id").select("doc_id", "pattern", importance.positional_column(mean, F.col("n_tokens")).alias("p"), (1 - F.col("n") / F.max("n").over(by)).alias("f"), (F.col("length") / F.max("length").over(by)).alias("l"))
    score = F.round(importance.composite_column(F.col("p"), F.col("f"), F.col("l")), 6)
    return rows.select("doc_id", "pattern", F.round("p", 6).alias("positional"), F.round("f", 6).alias("frequency"), F.round("l", 6).alias("length_score"), score.alias("score"), importance.boost_column(score).alias("boost"))


def bpe_round(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, left, right, n, savings): the best pair of each document; of equals the first in binary order; no shuffle."""

    def work(doc_id: object, words: list[str]) -> Iterator[tuple]:
        count = Counter(zip(words, words[1:]))
        for twice in [p for p in count if p[0] == p[1]]:
            # of a run of one token every second place is free
            count[twice] = sum(len(list(run)) // 2 for t, run in groupby(words) if t == twice[0])
        if count:
            most = max(count.values())
            if (saved := ar.raw_savings(2, most, config.extra)) > 0:
                yield doc_id, *min(p for p, n in count.items() if n == most), most, saved

    return per_document(docs, "doc_id bigint, left string, right string, n bigint, savings bigint", work)


def fuzzy_buckets(docs: DataFrame, length: int = 6) -> DataFrame:
    """(doc_id, signature, variants, places): windows that share their tokens at even places and differ elsewhere; no shuffle."""

    def work(doc_id: object, words: list[str]) -> Iterator[tuple]:
        n = len(words) - length + 1
        if n < 2:
            return
        even = list(zip(*(words[k : k + n] for k in range(0, length, 2))))
        places = Counter(even)
        variants: dict[tuple[str, ...], set[tuple[str, ...]]] = {}
        for signature, rest in zip(even, zip(*(words[k : k + n] for k in range(1, length, 2)))):
            if places[signature] > 1:
                variants.setdefault(signature, set()).add(rest)
        for signature, own in variants.items():
            if len(own) > 1:
                yield doc_id, " ".join(signature), len(own), places[signature]

    return per_document(docs, "doc_id bigint, signature string, variants bigint, places bigint", work)


_TEMPLATE = "doc_id bigint, frame string, slots int, instances bigint, savings bigint"


def discover_templates(docs: DataFrame, config: Config = Config(), single: bool = False) -> DataFrame:
    """(doc_id, frame, slots, instances, savings) of each document's templates."""
    find = templates.discover_single if single else templates.discover

    def work(doc_id: object, words: list[str]) -> Iterator[tuple]:
        for t in find(words, config):
            yield doc_id, templates.framed(t), t.slots, len(t.instances), t.savings(config.extra)

    return per_document(docs, _TEMPLATE, work)


_CODED = "doc_id bigint, n_tokens bigint, n_coded bigint, n_body bigint, n_patterns bigint, n_uses bigint, pattern_tokens bigint, longest int, n_candidates bigint, depth int, distinct_tokens bigint, distinct_body bigint, covered bigint, static_id string, passed boolean, stream array<string>"


def selected(docs: DataFrame, config: Config = Config(), embed: Callable | None = None) -> DataFrame:
    """(doc_id, start, length, pattern): the stretches of each document that the first pass chooses to replace; no shuffle."""
    validate(config)

    def work(doc_id: object, words: list[str]) -> Iterator[tuple]:
        found = pt.deduplicated(codec.discovered(words, config, None))
        for o in select(words, pt.without_subsumed(found, config) if config.prune_subsumed else found, config, embed):
            yield doc_id, o.start, o.length, " ".join(o.pattern)

    return per_document(docs, "doc_id bigint, start bigint, length bigint, pattern string", work)


def _coded(words: list[str], config: Config, embed: Callable | None) -> codec.Coded:
    """A document coded; as it is where it holds reserved tokens."""
    try:
        return codec.encode(words, config, embed=embed)
    except ValueError:
        if not any(codec.is_reserved(t, config) for t in words):
            raise
        return codec.Coded(words, words, {}, words)


def encode(docs: DataFrame, config: Config = Config(), embed: Callable | None = None, streams: bool = True) -> DataFrame:
    """Each document coded, with what its quality and metrics are computed from.

    ``passed`` tells whether the stream decodes to the document (null if the
    settings don't ask for that).  ``embed`` gives vectors of texts to semantic
    selection and importance.  Documents with reserved tokens can't be coded:
    they pass as they are.  Without ``streams`` the rest is the same, but the
    column ``stream`` isn't carried along, for those who don't read it.
    """
    validate(config)
    unchecked = config.but(verify=False)

    def work(doc_id: object, words: list[str]) -> Iterator[tuple]:
        c = _coded(words, unchecked, embed)
        uses = {t: 0 for t in c.entries}
        for t in c.body:
            if t in uses:
                uses[t] += 1
        sizes = [len(s) for s in c.entries.values()]
        yield (
            doc_id, len(words), len(c.stream), len(c.body), len(c.entries), sum(uses.values()), sum(sizes), max(sizes, default=0), c.candidates,
            max((c.depth.get(m, 0) for m in c.entries), default=0), len(set(words)), len(set(c.body)), sum(uses[m] * len(s) for m, s in c.entries.items()), c.static_id, codec.decode(c.stream, config) == words if config.verify else None, *([[str(t) for t in c.stream]] if streams else []),
        )

    return per_document(docs, _CODED if streams else _CODED.removesuffix(", stream array<string>"), work)


def decode(coded: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, text): the tokens that each stream stands for, joined by spaces."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams = (x for b in batches for x in zip(b.column("doc_id").to_pylist(), _pieces(b.column("stream"))))
        # a stream without a dictionary was passed as it was
        return _passed_on(((doc_id, " ".join(codec.decode(s or [], config))) for doc_id, s in streams), schema)

    return coded.select("doc_id", "stream").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, config: Config = Config(), embed: Callable | None = None) -> DataFrame:
    """(doc_id, text, no_longer): each document coded and decoded again, and whether coding kept it from growing.

    Both in one kernel: a stream goes as soon as it is decoded.
    """
    validate(config)
    unchecked = config.but(verify=False)

    def work(doc_id: object, words: list[str]) -> Iterator[tuple]:
        stream = [str(t) for t in _coded(words, unchecked, embed).stream]
        yield doc_id, " ".join(codec.decode(stream, config)), len(stream) <= len(words)

    return per_document(docs, "doc_id bigint, text string, no_longer boolean", work)


def template_round_trip(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, text, no_longer) with templates instead of plain patterns."""

    def work(doc_id: object, words: list[str]) -> Iterator[tuple]:
        stream = templates.encode(words, config)
        yield doc_id, " ".join(templates.decode(stream, config)), len(stream) <= len(words)

    return per_document(docs, "doc_id bigint, text string, no_longer boolean", work)


def metrics(coded: DataFrame) -> DataFrame:
    """Metrics of each coded document."""
    n, m = F.col("n_tokens"), F.col("n_coded")
    ratio = F.when(n > 0, m / n).otherwise(1.0)
    return coded.select(
        "doc_id",
        ratio.alias("compression_ratio"),
        (1 - ratio).alias("compression_amount"),
        (n - m).alias("effective_savings"),
        "n_candidates",
        F.col("n_patterns").alias("patterns_used"),
        F.when(F.col("n_patterns") > 0, F.col("pattern_tokens") / F.col("n_patterns")).otherwise(0.0).alias("avg_pattern_length"),
        F.when(F.col("n_patterns") > 0, F.col("n_uses") / F.col("n_patterns")).otherwise(0.0).alias("avg_pattern_frequency"),
        F.when(m > 0, (m - F.col("n_body")) / m).otherwise(0.0).alias("dictionary_overhead"),
        "depth",
    )


def reserved(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, reserved): whether a document holds tokens that coding reserves."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), has_reserved(tokens(F.col("text")), config).alias("reserved"))


def expanded(stream: Column, entries: Column, rounds: int) -> Column:
    """A stream with names replaced by what a map column holds for them, ``rounds`` levels deep; JVM-side."""
    out = stream
    for _ in range(rounds):
        out = F.flatten(F.transform(out, lambda t: F.coalesce(F.try_element_at(entries, t), F.array(t))))
    return out
