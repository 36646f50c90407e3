"""Queries by name over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motifloom.config import Config
from motifloom.functions import arithmetic as ar
from motifloom.functions.tokens import body_of, bracketed, bracketed_number, context, is_compressed, normal_text, token_count, tokens
from motifloom.operators import corpus, domains, quality, regions, shared
from motifloom.sources.embeddings import Hashed
from motifloom.streaming import chunks, monitor

FLAGSHIP = "ngram_candidates"
CONFIG = Config()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "documents")


def query(sql: str | None = None) -> Callable:
    """Registers a function as the query of its name."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# DuckDB: the same tokens as ``tokens`` gives, and windows of 2 to 8 of them
_FLAT = r"trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')"
_TOKENS = f"docs AS (SELECT doc_id, {_FLAT} AS flat FROM documents), w AS (SELECT doc_id, string_split(flat, ' ') AS w FROM docs WHERE flat <> '')"
_LONG = f"{_TOKENS}, long AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS i FROM w)"
_LEADS = ", ".join(f"lead(t, {k}) OVER d AS t{k}" for k in range(1, 8))
_GRAMS = " UNION ALL ".join(f"SELECT doc_id, i, {n} AS length, concat_ws(' ', t, {', '.join(f't{k}' for k in range(1, n))}) AS pattern FROM led WHERE t{n - 1} IS NOT NULL" for n in range(2, 9))
_FREE = "list_reduce(s, lambda a, p: CASE WHEN p >= a % 1000000 THEN (a // 1000000 + 1) * 1000000 + p + length ELSE a END, CAST(0 AS BIGINT)) // 1000000"
_CANDIDATES = f"""{_LONG}, led AS (SELECT doc_id, i, t, {_LEADS} FROM long WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
g AS ({_GRAMS}), raw AS (SELECT doc_id, length, pattern, list(i ORDER BY i) AS s FROM g GROUP BY ALL HAVING length * count(*) > 2 + length + count(*)),
counted AS (SELECT *, {_FREE} AS n FROM raw), cand AS (SELECT * FROM counted WHERE length * n > 2 + length + n)"""
_KEPT = "list_reduce(s, lambda a, p: CASE WHEN p >= a[1] THEN list_append([p + length], p) || a[2:] ELSE a END, [CAST(-1 AS BIGINT)])[2:]"
#: starts without overlap, of (doc_id, pattern, length, s)
_STARTS = f"{_CANDIDATES}, st AS (SELECT doc_id, pattern, length, n, {_KEPT} AS starts FROM cand)"
_PARTS = " UNION ALL ".join(f"SELECT doc_id, pattern AS outer_, {o} AS off, array_to_string(string_split(pattern, ' ')[{o + 1}:{o + k}], ' ') AS inner_ FROM cand WHERE length >= {max(o + k, k + 1)}" for k in range(2, 8) for o in range(0, 9 - k) if o + k <= 8)


@query(f"SELECT doc_id, {_FLAT} AS text, CAST(CASE WHEN {_FLAT} = '' THEN 0 ELSE len(string_split({_FLAT}, ' ')) END AS BIGINT) AS n_tokens FROM documents")
def tokenize_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", normal_text(F.col("text")).alias("text"), token_count(F.col("text")).alias("n_tokens"))


@query(f"WITH {_TOKENS} SELECT doc_id, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct, round(len(list_distinct(w)) / len(w), 6) AS diversity FROM w")
def token_diversity(spark: SparkSession, folder: str) -> DataFrame:
    w = F.size(F.array_distinct("w"))
    rows = _docs(spark, folder).select("doc_id", tokens(F.col("text")).alias("w")).filter(F.size("w") > 0)
    return rows.select("doc_id", w.cast("bigint").alias("n_distinct"), F.round(w / F.size("w"), 6).alias("diversity"))


@query("SELECT min(doc_id) AS doc_id, sha256(coalesce(text, '')) AS hash, count(*) AS copies FROM documents GROUP BY 2")
def exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return shared.duplicates(_docs(spark, folder))


@query(f"SELECT doc_id, source, n AS n_tokens FROM (SELECT *, CAST(CASE WHEN {_FLAT} = '' THEN 0 ELSE len(string_split({_FLAT}, ' ')) END AS BIGINT) AS n, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) AS r FROM documents) WHERE r = 1 AND n BETWEEN 5 AND 5000")
def preprocess_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return shared.preprocessed(_docs(spark, folder), 5, 5000).select("doc_id", "source", "n_tokens")


@query(f"WITH {_CANDIDATES} SELECT doc_id, pattern, CAST(length AS BIGINT) AS length, n FROM cand")
def ngram_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.candidates(_docs(spark, folder), CONFIG).select("doc_id", "pattern", "length", "n")


@query(f"WITH {_CANDIDATES} SELECT doc_id, pattern, CAST(length AS BIGINT) AS length, n FROM cand")
def ngram_candidates_declared(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.candidates_declared(_docs(spark, folder), CONFIG).select("doc_id", "pattern", "length", "n")


@query(f"WITH {_CANDIDATES} SELECT doc_id, pattern, CAST(length AS BIGINT) AS length, n FROM cand")
def suffix_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.candidates(_docs(spark, folder), CONFIG, "suffix-array").select("doc_id", "pattern", "length", "n")


@query(f"WITH {_CANDIDATES} SELECT doc_id, pattern, CAST(length * n - 2 - length - n AS BIGINT) AS savings, CAST(length AS BIGINT) - 1 AS marginal, CAST(ceil((3 + length) / (length - 1)) AS BIGINT) AS least_count FROM cand")
def ngram_savings(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.with_savings(corpus.candidates(_docs(spark, folder), CONFIG), CONFIG).select("doc_id", "pattern", "savings", "marginal", "least_count")


@query(f"WITH {_CANDIDATES}, r AS (SELECT doc_id, pattern, CAST(length AS BIGINT) AS length, n, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, n DESC, pattern) AS rank FROM cand) SELECT doc_id, pattern, length, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def top_patterns(spark: SparkSession, folder: str) -> DataFrame:
    by = Window.partitionBy("doc_id").orderBy(F.desc("length"), F.desc("n"), "pattern")
    found = corpus.candidates(_docs(spark, folder), CONFIG).select("doc_id", "pattern", "length", "n")
    return found.withColumn("rank", F.row_number().over(by)).filter("rank <= 10")


@query(f"WITH {_CANDIDATES}, p AS ({_PARTS}) SELECT DISTINCT p.doc_id, outer_ AS longer, inner_ AS shorter FROM p JOIN cand c ON c.doc_id = p.doc_id AND c.pattern = p.inner_")
def subsumption_edges(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.containment(corpus.candidates(_docs(spark, folder), CONFIG))


@query(f"WITH {_CANDIDATES}, p AS ({_PARTS}) SELECT doc_id, pattern, CAST(length AS BIGINT) AS length, n FROM cand c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = c.doc_id AND p.inner_ = c.pattern)")
def maximal_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.maximal(corpus.candidates(_docs(spark, folder), CONFIG)).select("doc_id", "pattern", "length", "n")


_COVER = f"""{_STARTS}, p AS ({_PARTS}), cov AS (SELECT DISTINCT p.doc_id, p.inner_ AS pattern, s.u + p.off AS u FROM p JOIN (SELECT doc_id, pattern, unnest(starts) AS u FROM st) s ON s.doc_id = p.doc_id AND s.pattern = p.outer_ WHERE EXISTS (SELECT 1 FROM cand c WHERE c.doc_id = p.doc_id AND c.pattern = p.inner_)),
own AS (SELECT doc_id, pattern, length, unnest(starts) AS u FROM st), inn AS (SELECT DISTINCT doc_id, inner_ AS pattern FROM p)"""


@query(f"""WITH {_COVER} SELECT doc_id, pattern, CAST(length AS BIGINT) AS length, n FROM st ANTI JOIN inn USING (doc_id, pattern)
UNION ALL SELECT doc_id, pattern, CAST(length AS BIGINT), count(*) FROM (SELECT own.* FROM own ANTI JOIN cov USING (doc_id, pattern, u)) x SEMI JOIN inn USING (doc_id, pattern) GROUP BY ALL HAVING count(*) >= 2 AND length * count(*) > 2 + length + count(*)""")
def pruned_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.pruned(_docs(spark, folder), CONFIG)


@query(f"""WITH {_COVER}, e AS (SELECT DISTINCT p.doc_id, outer_, inner_ FROM p JOIN cand c ON c.doc_id = p.doc_id AND c.pattern = p.inner_), h AS (SELECT doc_id, outer_ AS pattern, count(*) AS h FROM e GROUP BY ALL),
c AS (SELECT doc_id, pattern, count(*) AS covered FROM own SEMI JOIN cov USING (doc_id, pattern, u) GROUP BY ALL), b AS (SELECT *, length * n - 2 - length - n AS base FROM st)
SELECT b.doc_id, b.pattern, b.n, CAST(coalesce(covered, 0) AS BIGINT) AS covered, round(base - base * coalesce(covered, 0) / n * 0.8 + CASE WHEN i.pattern IS NULL THEN base * 0.1 ELSE 0 END + coalesce(h, 0) * 0.5, 6) AS score
FROM b LEFT JOIN h USING (doc_id, pattern) LEFT JOIN c USING (doc_id, pattern) LEFT JOIN (SELECT DISTINCT doc_id, inner_ AS pattern FROM e) i ON i.doc_id = b.doc_id AND i.pattern = b.pattern""")
def independent_value(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.own_values(_docs(spark, folder), CONFIG)


@query(f"WITH {_CANDIDATES} SELECT doc_id, pattern, round(least(1.0, n * length / len(w)), 6) AS coverage FROM cand JOIN w USING (doc_id)")
def coverage_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    return corpus.coverage(corpus.candidates(docs, CONFIG), docs)


@query(f"""WITH {_STARTS}, x AS (SELECT doc_id, pattern, exp(-2.0 * (list_sum(starts) / n) / len(w)) AS p, 1 - n / max(n) OVER d AS f, length / max(length) OVER d AS l FROM st JOIN w USING (doc_id) WINDOW d AS (PARTITION BY doc_id))
SELECT doc_id, pattern, round(p, 6) AS positional, round(f, 6) AS frequency, round(l, 6) AS length_score, round(p * 0.4 + f * 0.3 + l * 0.3, 6) AS score, CAST(floor((1 - round(p * 0.4 + f * 0.3 + l * 0.3, 6)) * 5) AS BIGINT) AS boost FROM x""")
def importance_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    return corpus.importance_scores(corpus.candidates(docs, CONFIG), docs)


@query(f"""WITH {_LONG}, pr AS (SELECT doc_id, i, t, lead(t) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM long), raw AS (SELECT doc_id, t, r, 2 AS length, list(i ORDER BY i) AS s FROM pr WHERE r IS NOT NULL GROUP BY ALL),
c AS (SELECT doc_id, t, r, {_FREE} AS n FROM raw), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, t, r) AS k FROM c WHERE 2 * n - 4 - n > 0)
SELECT doc_id, t AS "left", r AS "right", n, CAST(n - 4 AS BIGINT) AS savings FROM k WHERE k = 1""")
def bpe_best_pair(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.bpe_round(_docs(spark, folder), CONFIG)


@query()
def bpe_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.candidates(_docs(spark, folder), CONFIG, "bpe").select("doc_id", "pattern", "length", "n")


@query()
def extended_bpe_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.candidates(_docs(spark, folder), CONFIG, "bpe-extended").select("doc_id", "pattern", "length", "n")


@query()
def fuzzy_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.candidates(_docs(spark, folder), CONFIG, "fuzzy").select("doc_id", "pattern", "length", "n")


@query()
def syntax_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.candidates(_docs(spark, folder), CONFIG, "syntax").select("doc_id", "pattern", "length", "n")


@query(f"""WITH {_LONG}, led AS (SELECT doc_id, t, {_LEADS} FROM long WINDOW d AS (PARTITION BY doc_id ORDER BY i)), g AS (SELECT doc_id, concat_ws(' ', t, t2, t4) AS signature, concat_ws(' ', t, t1, t2, t3, t4, t5) AS gram FROM led WHERE t5 IS NOT NULL)
SELECT doc_id, signature, count(DISTINCT gram) AS variants, count(*) AS places FROM g GROUP BY ALL HAVING count(DISTINCT gram) > 1""")
def fuzzy_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.fuzzy_buckets(_docs(spark, folder))


@query()
def templates(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.discover_templates(_docs(spark, folder), CONFIG)


@query()
def single_slot_templates(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.discover_templates(_docs(spark, folder), CONFIG, single=True)


@query(f"""WITH {_CANDIDATES}, a AS (SELECT pattern, CAST(length AS BIGINT) AS length, CAST(sum(n) AS BIGINT) AS total, count(*) AS documents FROM cand GROUP BY pattern, length),
r AS (SELECT *, round(CAST((length * total - 2 - length - total) * documents AS DOUBLE), 6) AS score FROM a WHERE length * total > 2 + length + total), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, length DESC, pattern) AS rank FROM r)
SELECT CAST(rank AS INTEGER) AS rank, '<SD_' || (rank - 1) || '>' AS meta, pattern, length, total, documents, score FROM k WHERE rank <= 256""")
def static_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    return shared.static_dictionary(_docs(spark, folder), CONFIG)


@query()
def document_weights(spark: SparkSession, folder: str) -> DataFrame:
    return shared.weights(_table(spark, folder, "embeddings")).select("vec_id", "weight")


@query()
def offline_analysis(spark: SparkSession, folder: str) -> DataFrame:
    from motifloom.plans import offline

    return offline.analysed(_docs(spark, folder), Hashed(32), CONFIG)


def _listed(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(f"""WITH {_TOKENS}, all_ AS (SELECT documents.doc_id, coalesce(w.w, []) AS w FROM documents LEFT JOIN w USING (doc_id)), l AS (SELECT doc_id, greatest(len(w), 1) AS n, list_transform(w, lambda t: lower(t)) AS w FROM all_),
h AS (SELECT doc_id, n, len(list_filter(w, lambda t: list_contains({_listed(domains.PYTHON)}, t))) AS p, len(list_filter(w, lambda t: list_contains({_listed(domains.JSON)}, t))) AS j, len(list_filter(w, lambda t: list_contains({_listed(domains.POLICY)}, t))) AS o, len(list_filter(w, lambda t: contains(t, ':'))) AS c FROM l),
s AS (SELECT *, (p + c * 0.2) / n AS ps, j / n AS js, o / n AS os FROM h), d AS (SELECT *, CASE WHEN p >= 2 AND ps >= 0.08 THEN 'code-python' WHEN j >= 4 AND js >= 0.12 THEN 'json' WHEN o >= 3 AND os >= 0.1 THEN 'security-policy' END AS domain FROM s)
SELECT doc_id, CAST(p AS BIGINT) AS python_hits, CAST(j AS BIGINT) AS json_hits, CAST(o AS BIGINT) AS policy_hits, domain, round(CASE domain WHEN 'code-python' THEN least(1.0, ps + 0.25) WHEN 'json' THEN least(1.0, js + 0.2) WHEN 'security-policy' THEN least(1.0, os + 0.2) ELSE 0.0 END, 6) AS confidence FROM d""")
def domain_detection(spark: SparkSession, folder: str) -> DataFrame:
    return domains.detect(_docs(spark, folder))


@query(f"WITH {_TOKENS} SELECT documents.doc_id, coalesce(len(list_filter(w.w, lambda t: regexp_matches(t, '^(?:<Dict>|</Dict>|<Patch>|</Patch>|<Slot>|<SlotVal>|</SlotVal>|<(?:MT_|Idx:|StaticDict:|SD_|Len:).*>)$'))), 0) > 0 AS reserved FROM documents LEFT JOIN w USING (doc_id)")
def reserved_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.reserved(_docs(spark, folder), CONFIG)


@query(f"WITH {_TOKENS} SELECT doc_id, '<Len:' || len(w) || '>' AS length_token, CAST(len(w) AS BIGINT) AS parsed, w[1] LIKE '<MT\\_%>' ESCAPE '\\' AS first_is_meta, false AS compressed, array_to_string(w, ' ') AS body, array_to_string(w[1:11], ' ') AS context FROM w")
def marked_tokens(spark: SparkSession, folder: str) -> DataFrame:
    from motifloom.functions.tokens import is_meta

    w = F.col("w")
    rows = _docs(spark, folder).select("doc_id", tokens(F.col("text")).alias("w")).filter(F.size("w") > 0)
    mark = bracketed(F.size(w), CONFIG.length_mark)
    return rows.select("doc_id", mark.alias("length_token"), bracketed_number(mark, CONFIG.length_mark).alias("parsed"), is_meta(F.get(w, F.lit(0))).alias("first_is_meta"), is_compressed(w).alias("compressed"), F.array_join(body_of(w), " ").alias("body"), F.array_join(context(w, F.lit(1), F.lit(2), 8), " ").alias("context"))


def _embed(texts: list[str]) -> list[list[float]]:
    return Hashed(16).embed(texts)


# DuckDB: the stretches that greedy selection takes in one pass: the longest first, then from the left, whatever fits;
# again without the patterns that were taken too rarely to pay, ten times
_FITS = "len(list_filter(a, lambda c: c // 16 < x[1] // 16 + x[1] % 16 AND c // 16 + c % 16 > x[1] // 16)) = 0"
_PRUNED_STARTS = f"""{_COVER}, rest AS (SELECT * FROM own ANTI JOIN cov USING (doc_id, pattern, u) SEMI JOIN inn USING (doc_id, pattern)), many AS (SELECT doc_id, pattern FROM rest GROUP BY ALL HAVING count(*) >= 2 AND any_value(length) * count(*) > 2 + any_value(length) + count(*)),
s0 AS MATERIALIZED (SELECT doc_id, pattern, CAST(length AS BIGINT) AS length, CAST(u AS BIGINT) AS u FROM (SELECT * FROM own ANTI JOIN inn USING (doc_id, pattern) UNION ALL SELECT * FROM rest SEMI JOIN many USING (doc_id, pattern)))"""


def _round(k: int) -> str:
    return f"""c{k} AS (SELECT doc_id, unnest(list_reduce(list_prepend(CAST([] AS BIGINT[]), list([u * 16 + length] ORDER BY length DESC, u)), lambda a, x: CASE WHEN {_FITS} THEN a || x ELSE a END)) AS c FROM s{k} GROUP BY doc_id),
e{k} AS MATERIALIZED (SELECT s{k}.* FROM c{k} JOIN s{k} ON s{k}.doc_id = c{k}.doc_id AND s{k}.u = c // 16 AND s{k}.length = c % 16), poor{k} AS MATERIALIZED (SELECT doc_id, pattern FROM e{k} GROUP BY ALL HAVING any_value(length) * count(*) <= 2 + any_value(length) + count(*)),
s{k + 1} AS MATERIALIZED (SELECT * FROM s{k} ANTI JOIN poor{k} USING (doc_id, pattern))"""


_GREEDY = f"{_PRUNED_STARTS}, {', '.join(map(_round, range(10)))}, taken AS MATERIALIZED (SELECT doc_id, u AS start, length, pattern FROM e9 ANTI JOIN poor9 USING (doc_id, pattern))"
# what one pass of coding makes of them: 500 names at most, and no coding where it isn't shorter
_CODING = f"""{_GREEDY}, nm AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS r FROM (SELECT doc_id, pattern, length, count(*) AS n, min(start) AS first FROM taken GROUP BY doc_id, pattern, length)), k AS (SELECT doc_id, count(*) AS k, sum(n) AS uses, sum(length) AS pt, sum(n * (length - 1)) AS saved, sum(n * length) AS covered FROM nm WHERE r <= 500 GROUP BY doc_id),
gone AS (SELECT doc_id, unnest(range(start, start + length)) AS i FROM taken SEMI JOIN (SELECT * FROM nm WHERE r <= 500) USING (doc_id, pattern)), db AS (SELECT doc_id, count(DISTINCT t) AS db FROM long ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id), tt AS (SELECT doc_id, len(w) AS n, len(list_distinct(w)) AS dt FROM w),
kk AS (SELECT tt.*, CASE WHEN k IS NOT NULL AND n - saved + 2 + 2 * k + pt <= n THEN 1 ELSE 0 END AS shorter, coalesce(k, 0) AS k, coalesce(uses, 0) AS uses, coalesce(pt, 0) AS pt, coalesce(saved, 0) AS saved, coalesce(covered, 0) AS covered, coalesce(db, 0) AS db FROM tt LEFT JOIN k USING (doc_id) LEFT JOIN db USING (doc_id)),
coding AS MATERIALIZED (SELECT documents.doc_id, documents.source, documents.text, CAST(coalesce(n, 0) AS BIGINT) AS n_tokens, CAST(coalesce(CASE WHEN shorter = 1 THEN n - saved + 2 + 2 * k + pt ELSE n END, 0) AS BIGINT) AS n_coded, CAST(coalesce(CASE WHEN shorter = 1 THEN n - saved ELSE n END, 0) AS BIGINT) AS n_body, CAST(coalesce(k * shorter, 0) AS BIGINT) AS n_patterns, CAST(coalesce(uses * shorter, 0) AS BIGINT) AS n_uses,
CAST(coalesce(pt * shorter, 0) AS BIGINT) AS pattern_tokens, CAST(coalesce(dt, 0) AS BIGINT) AS distinct_tokens, CAST(coalesce(CASE WHEN shorter = 1 THEN db + k ELSE dt END, 0) AS BIGINT) AS distinct_body, CAST(coalesce(covered * shorter, 0) AS BIGINT) AS covered FROM documents LEFT JOIN kk USING (doc_id))"""
SINGLE_PASS = Config(hierarchical=False)


@query(f"WITH {_GREEDY} SELECT doc_id, start, length, pattern FROM taken")
def greedy_stretches(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.selected(_docs(spark, folder), SINGLE_PASS)


@query(f"WITH {_CODING} SELECT doc_id, n_tokens, n_coded, n_body, n_patterns, n_uses, pattern_tokens, distinct_tokens, distinct_body, covered, true AS passed FROM coding")
def coding_single_pass(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.encode(_docs(spark, folder), SINGLE_PASS, streams=False).select("doc_id", "n_tokens", "n_coded", "n_body", "n_patterns", "n_uses", "pattern_tokens", "distinct_tokens", "distinct_body", "covered", "passed")


_ROUND_TRIP = f"SELECT doc_id, {_FLAT} AS text, true AS no_longer FROM documents"


def _round_trip(name: str, config: Config) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return corpus.round_trip(_docs(spark, folder), config, _embed if config.selection == "semantic" else None)

    run.__name__ = f"roundtrip_{name}"
    query(_ROUND_TRIP)(run)


for _name, _config in {
    "greedy": Config(),
    "optimal": Config(selection="optimal"),
    "beam": Config(selection="beam", hierarchical=False),
    "ilp": Config(selection="ilp", hierarchical=False),
    "semantic": Config(selection="semantic"),
    "suffix_array": Config(discovery="suffix-array", hierarchical=False),
    "bpe": Config(discovery="bpe", hierarchical=False, max_length=16),
    "fuzzy": Config(fuzzy=True, max_length=6),
    "static": Config(static_id="python-v1"),
    "no_lengths": Config(length_tokens=False),
    "unpruned": Config(prune_subsumed=False),
    "weighed": Config(regions=True, importance=True),
}.items():
    _round_trip(_name, _config)


@query(_ROUND_TRIP)
def roundtrip_template(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.template_round_trip(_docs(spark, folder), CONFIG)


@query(f"SELECT doc_id, {_FLAT} AS text FROM documents WHERE {_FLAT} <> ''")
def stream_reassemble(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.reassembled(chunks.chunked(_docs(spark, folder), 512, 64), 64)


@query(f"WITH {_TOKENS}, c AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 64, 1), 448)) AS s FROM w) SELECT doc_id, CAST(s // 448 AS BIGINT) AS chunk, CAST(least(512, len(w) - s) AS BIGINT) AS n_tokens, array_to_string(w[s + 1:s + 512], ' ') AS text FROM c")
def stream_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.chunked(_docs(spark, folder), 512, 64)


def _records(coded: DataFrame) -> DataFrame:
    found = quality.predicted(quality.features(coded))
    return found.select("doc_id", "compression_ratio", "degradation", F.col("dict_overhead").alias("overhead"), F.col("n_patterns").alias("patterns_used"), "original_length", "compressed_length", "passed", F.lit(None).cast("double").alias("latency_ms"))


@query()
def compression_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.metrics(corpus.encode(_docs(spark, folder), CONFIG, streams=False))


@query()
def quality_predictions(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.predicted(quality.features(corpus.encode(_docs(spark, folder), CONFIG, streams=False)))
    return found.select("doc_id", F.round("degradation", 6).alias("degradation"), "recommendation", F.round("suggested_ratio", 6).alias("suggested_ratio"), F.array_join("risks", "; ").alias("risks"))


@query()
def compression_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.summary(_records(corpus.encode(_docs(spark, folder), CONFIG, streams=False)))


@query()
def ratio_cube(spark: SparkSession, folder: str) -> DataFrame:
    from motifloom.plans import offline

    docs = _docs(spark, folder)
    return offline.ratio_by_group(corpus.encode(docs, CONFIG, streams=False), docs, "lang", "source")


# the log of coding all documents in one pass: ratio, predicted degradation, share of the dictionary, patterns, lengths, and whether each decodes
_LOG = f"""{_CODING}, v AS (SELECT *, CASE WHEN n_tokens > 0 THEN n_coded / n_tokens ELSE 1 END AS r, CASE WHEN n_coded > 0 THEN (n_coded - n_body) / n_coded ELSE 0 END AS o, CASE WHEN n_patterns > 0 THEN pattern_tokens / n_patterns ELSE 0 END AS al, CASE WHEN n_tokens > 0 THEN distinct_tokens / n_tokens ELSE 1 END AS b4, CASE WHEN n_coded > 0 THEN distinct_body / n_coded ELSE 1 END AS af FROM coding),
log AS MATERIALIZED (SELECT doc_id, source, r, o, n_patterns AS p, n_tokens AS a, n_coded AS b, true AS ok, round(least(CASE WHEN r < 0.5 THEN (0.5 - r) * 0.15 ELSE 0 END + CASE WHEN r < 0.3 THEN (0.3 - r) * 0.2 ELSE 0 END + CASE WHEN al < 3 AND n_patterns > 10 THEN 0.03 ELSE 0 END + CASE WHEN o > 0.3 THEN 0.02 ELSE 0 END + CASE WHEN o > 0.5 THEN 0.03 ELSE 0 END
+ CASE WHEN (CASE WHEN b4 > 0 THEN af / b4 ELSE 1 END) < 0.7 THEN 0.02 ELSE 0 END + CASE WHEN n_tokens < 100 AND n_patterns > 5 THEN 0.02 ELSE 0 END, 1), 9) AS d FROM v)"""


def _log(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    return _records(corpus.encode(docs, SINGLE_PASS, streams=False)).join(docs.select("doc_id", "source"), "doc_id")


@query(f"""WITH {_LOG} SELECT source, count(*) AS records, round(avg(r), 6) AS ratio_mean, round(quantile_cont(r, 0.5), 6) AS ratio_p50, round(quantile_cont(r, 0.95), 6) AS ratio_p95, round(quantile_cont(d, 0.99), 6) AS degradation_p99, round(max(o), 6) AS overhead_max,
round(avg(p), 6) AS patterns_mean, round(count(*) FILTER (NOT ok) / count(*), 6) AS failure_rate, CAST(sum(a) AS BIGINT) AS tokens_processed, CAST(sum(a - b) AS BIGINT) AS tokens_saved FROM log GROUP BY source""")
def quality_summary(spark: SparkSession, folder: str) -> DataFrame:
    s = quality.summary(_log(spark, folder), ["source"], exact=True)
    r = lambda c, n: F.round(c, 6).alias(n)
    return s.select("source", "records", r("compression_ratio_mean", "ratio_mean"), r("compression_ratio_p50", "ratio_p50"), r("compression_ratio_p95", "ratio_p95"), r("degradation_p99", "degradation_p99"), r("overhead_max", "overhead_max"), r("patterns_mean", "patterns_mean"), r("failure_rate", "failure_rate"), "tokens_processed", "tokens_saved")


@query(f"""WITH {_LOG}, s AS (SELECT source, avg(r) AS a, quantile_cont(r, 0.95) AS b, avg(d) AS c, quantile_cont(d, 0.95) AS e, avg(o) AS f, count(*) FILTER (NOT ok) / count(*) AS g FROM log GROUP BY source),
l AS (SELECT source, unnest([{{'m': 'compression_ratio_mean', 'v': a, 'w': 0.85, 'c': 0.95}}, {{'m': 'compression_ratio_p95', 'v': b, 'w': 0.9, 'c': 0.98}}, {{'m': 'degradation_mean', 'v': c, 'w': 0.03, 'c': 0.08}}, {{'m': 'degradation_p95', 'v': e, 'w': 0.05, 'c': 0.1}}, {{'m': 'overhead_mean', 'v': f, 'w': 0.4, 'c': 0.6}}, {{'m': 'failure_rate', 'v': g, 'w': 0.01, 'c': 0.05}}]) AS x FROM s)
SELECT source, x.m AS metric, round(x.v, 6) AS value, CASE WHEN x.v >= x.c THEN 'critical' ELSE 'warning' END AS severity, CAST(CASE WHEN x.v >= x.c THEN x.c ELSE x.w END AS DOUBLE) AS threshold FROM l WHERE x.v >= x.w""")
def quality_alerts(spark: SparkSession, folder: str) -> DataFrame:
    raised = quality.alerts(quality.summary(_log(spark, folder), ["source"], exact=True), keys=["source"])
    return raised.withColumn("value", F.round("value", 6))


@query("WITH l AS (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) SELECT round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev, list_sort(list(value))[CAST(floor(count(*) * 0.95) AS INTEGER) + 1] AS p95, count(*) AS n FROM l")
def baseline(spark: SparkSession, folder: str) -> DataFrame:
    b = quality.baseline(_table(spark, folder, "events").withColumn("at", F.struct("ts", "event_id")), "value", "at")
    return b.select(F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"), "p95", "n")


@query("WITH b AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 100)) SELECT event_id, value, round((value - m) / s, 6) AS z FROM events, b WHERE abs((value - m) / s) > 2")
def anomalies(spark: SparkSession, folder: str) -> DataFrame:
    events = _table(spark, folder, "events")
    base = quality.baseline(events.withColumn("at", F.struct("ts", "event_id")), "value", "at")
    return quality.anomalies(events, base, "value").select("event_id", "value", F.round("z", 6).alias("z"))


@query("WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((value - lo) / ((hi - lo) / 10)), 9) END AS INTEGER) AS bin, lo, (hi - lo) / 10 AS w FROM events, e WHERE value IS NOT NULL) SELECT bin, round(any_value(lo) + bin * any_value(w), 6) AS low, count(*) AS n FROM b GROUP BY bin")
def histogram(spark: SparkSession, folder: str) -> DataFrame:
    return quality.histogram(_table(spark, folder, "events"), "value")


@query("SELECT event_id, round(avg(value) OVER w, 6) AS rolling_mean, max(value) OVER w AS rolling_max, count(*) OVER w AS rolling_n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def rolling_monitor(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.rolling(_table(spark, folder, "events").withColumn("at", F.struct("ts", "event_id")), "value", "user_id", "at")
    return rows.select("event_id", F.round("rolling_mean", 6).alias("rolling_mean"), "rolling_max", "rolling_n")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 hour, ts)) // 1000000 AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, folder: str) -> DataFrame:
    w = monitor.windowed(_table(spark, folder, "events"), "value", keys=("event_type",))
    return w.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


@query("WITH s AS (SELECT time_bucket(INTERVAL 30 minutes, ts) AS b, value FROM events), x AS (SELECT b AS start, value FROM s UNION ALL SELECT b - INTERVAL 30 minutes, value FROM s) SELECT epoch_us(start) // 1000000 AS start, count(*) AS n, round(avg(value), 6) AS mean FROM x GROUP BY 1")
def sliding_windows(spark: SparkSession, folder: str) -> DataFrame:
    w = monitor.windowed(_table(spark, folder, "events"), "value", slide="30 minutes")
    return w.select(F.unix_timestamp("start").alias("start"), "n", F.round("mean", 6).alias("mean"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 minutes THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 30 minutes) AS \"end\", count(*) AS n FROM s GROUP BY user_id, s")
def session_windows(spark: SparkSession, folder: str) -> DataFrame:
    s = monitor.sessions(_table(spark, folder, "events"), "user_id")
    return s.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start"), F.unix_micros(F.col("end").cast("timestamp")).alias("end"), "n")


@query("SELECT event_type, count(*) AS operations, count(*) FILTER (value > 0) AS ok, CAST(sum(greatest(event_id % 1000 - user_id % 100, 0)) AS BIGINT) AS tokens_saved FROM events GROUP BY event_type")
def session_statistics(spark: SparkSession, folder: str) -> DataFrame:
    saved = F.greatest(F.col("event_id") % 1000 - F.col("user_id") % 100, F.lit(0))
    return _table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("operations"), F.count_if(F.col("value") > 0).alias("ok"), F.sum(saved).cast("bigint").alias("tokens_saved"))


_PRICES = ", ".join(f"('{m}', {p})" for m, p in quality.PRICES.items())


@query(f"WITH {_LOG}, s AS (SELECT source, sum(a - b) AS saved FROM log GROUP BY source) SELECT source, m AS model, round(greatest(saved, 0) * p / 1e6, 6) AS saved_usd FROM s, (VALUES {_PRICES}) AS t(m, p)")
def cost_estimate(spark: SparkSession, folder: str) -> DataFrame:
    saved = quality.summary(_log(spark, folder), ["source"]).select("source", "tokens_saved")
    return quality.cost(saved, spark.createDataFrame(list(quality.PRICES.items()), "model string, usd_per_million double")).select("source", "model", "saved_usd")


@query(f"WITH {_LOG}, s AS (SELECT source, avg(r) AS r FROM log GROUP BY source) SELECT source, CASE WHEN r > 0.95 THEN 'poor' WHEN r > 0.85 THEN 'fair' WHEN r > 0.7 THEN 'good' ELSE 'excellent' END AS health, CASE WHEN 100 * (1 - r) > 15 THEN 'highly_recommended' WHEN 100 * (1 - r) > 5 THEN 'recommended' WHEN 100 * (1 - r) > 1 THEN 'marginal' ELSE 'not_recommended' END AS advice FROM s")
def health_by_source(spark: SparkSession, folder: str) -> DataFrame:
    s = quality.summary(_log(spark, folder), ["source"])
    mean = F.col("compression_ratio_mean")
    return s.select("source", quality.health(mean).alias("health"), quality.advice(100 * (1 - mean)).alias("advice"))


_TURN = r"CAST(CASE WHEN trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') = '' THEN 0 ELSE len(string_split(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' '), ' ')) END AS BIGINT)"
_REGIONS = f"t AS (SELECT conv_id, turn, CASE WHEN role IN ({', '.join(repr(k) for k in regions.SETTINGS)}) THEN role ELSE 'unknown' END AS kind, {_TURN} AS n FROM conversations), f AS (SELECT *, sum(n) OVER w AS e, CASE WHEN lag(kind) OVER w = kind THEN 0 ELSE 1 END AS f FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), i AS (SELECT *, sum(f) OVER (PARTITION BY conv_id ORDER BY turn) AS region FROM f), r AS (SELECT conv_id, region, kind, min(e - n) AS s, max(e) AS e FROM i GROUP BY ALL)"


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "conversations").withColumn("n_tokens", token_count(F.col("text")))


@query(f"WITH {_REGIONS} SELECT conv_id, CAST(region AS BIGINT) AS region, kind, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS \"end\" FROM r")
def conversation_regions(spark: SparkSession, folder: str) -> DataFrame:
    return regions.of_turns(_turns(spark, folder))


@query(f"WITH {_REGIONS} SELECT kind, CAST(sum(e - s) AS BIGINT) AS tokens, count(*) AS regions FROM r GROUP BY kind")
def region_stats(spark: SparkSession, folder: str) -> DataFrame:
    return regions.of_turns(_turns(spark, folder)).groupBy("kind").agg(F.sum(F.col("end") - F.col("start")).alias("tokens"), F.count("*").alias("regions"))


@query(f"WITH {_REGIONS}, p AS (SELECT conv_id, turn, (e - n) + n // 2 AS at FROM i) SELECT p.conv_id, p.turn, CAST(p.at AS BIGINT) AS at, r.kind FROM p LEFT JOIN r ON r.conv_id = p.conv_id AND r.s <= p.at AND p.at < r.e")
def region_lookup(spark: SparkSession, folder: str) -> DataFrame:
    turns = _turns(spark, folder)
    by = Window.partitionBy("conv_id").orderBy("turn")
    end = F.sum("n_tokens").over(by)
    points = turns.select("conv_id", "turn", (end - F.col("n_tokens") + F.floor(F.col("n_tokens") / 2)).alias("at"))
    return regions.located(points, regions.of_turns(turns), "conv_id", "at")


@query("SELECT a.label, (SELECT count(*) FROM embeddings e WHERE e.label = a.label) AS n, round(avg(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label")
def mean_pairwise_cosine(spark: SparkSession, folder: str) -> DataFrame:
    return shared.mean_cosine(_table(spark, folder, "embeddings"), "label").select("label", "n", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH t AS (SELECT conv_id, turn, role, {_TURN} AS n FROM conversations), p AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM t)
SELECT conv_id, turn, CAST(p + n AS BIGINT) AS n_input, n AS n_target, CAST('0x' || substr(md5(conv_id || ':' || turn), 1, 8) AS BIGINT) / 4294967296.0 < 0.5 AS compressed FROM p WHERE role = 'assistant' AND p > 0""")
def training_examples(spark: SparkSession, folder: str) -> DataFrame:
    return shared.training_examples(_table(spark, folder, "conversations"))


@query("SELECT range AS ord, '<MT_' || range || '>' AS token, 'meta' AS kind FROM range(500) UNION ALL SELECT * FROM (VALUES (500, '<Dict>', 'special'), (501, '</Dict>', 'special'), (502, '<Len:0>', 'special'))")
def vocabulary_plan(spark: SparkSession, folder: str) -> DataFrame:
    return shared.vocabulary(spark)


@query(f"""WITH {_CANDIDATES}, c AS (SELECT pattern, CAST(length AS BIGINT) AS length, count(*) AS frequency, CAST(sum(n) AS BIGINT) AS occurrences, CAST(sum(greatest(length * n - 2 - length - n, 0)) AS BIGINT) AS savings FROM cand GROUP BY ALL)
SELECT pattern, length, frequency, occurrences, savings FROM c""")
def pattern_cache(spark: SparkSession, folder: str) -> DataFrame:
    return shared.learned(None, corpus.candidates(_docs(spark, folder), CONFIG), 0, CONFIG).select("pattern", "length", "frequency", "occurrences", "savings")


@query()
def warm_start(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    cache = shared.learned(None, corpus.candidates(docs, CONFIG), 0, CONFIG)
    return shared.warm_start(docs, cache, 0)


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, event_type FROM events")
def event_properties(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type")


def _least_count(length: str) -> str:
    return f"CAST(ceil((3 + {length}) / ({length} - 1)) AS BIGINT)"


@query(f"SELECT CAST(l AS BIGINT) AS length, CAST(k AS BIGINT) AS count, l > 1 AND l * k > 2 + l + k AS pays, CAST(greatest(l * k - 2 - l - k, 0) AS BIGINT) AS savings, {_least_count('l')} AS least_count FROM range(2, 17) a(l), range(1, 33) b(k)")
def savings_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.range(2, 17).withColumnRenamed("id", "length").crossJoin(spark.range(1, 33).withColumnRenamed("id", "count"))
    n, k = F.col("length"), F.col("count")
    return rows.select("length", "count", ar.pays_column(n, k).alias("pays"), ar.savings_column(n, k).alias("savings"), ar.least_count_column(n).alias("least_count"))
