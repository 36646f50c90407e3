import json
import random

import pytest
from pyspark.sql import functions as F

from motifloom.config import Config
from motifloom.functions.tokens import whole_numbers
from motifloom.operators import alerting, codec, corpus, domains, quality, regions, shared, stages, templates
from motifloom.operators import patterns as pt
from motifloom.plans import offline, tools
from motifloom.plans.service import Session
from motifloom.sources import corpora, embeddings, sinks, tokenizers
from motifloom.streaming import chunks, monitor


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(5, 90)))) for i in range(30)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "one"), (104, rows[0][1]), (105, "a\tb  a b\na b a b a b"), (106, "x <Dict> y")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def words(text):
    return (text or "").split()


def test_kernel_and_plan_agree(spark, docs):
    found = {(r.doc_id, r.pattern, r.n) for r in corpus.candidates(docs).collect()}
    assert found == {(r.doc_id, r.pattern, r.n) for r in corpus.candidates_declared(docs).collect()}
    assert found == {(d.doc_id, " ".join(c.tokens), len(c.starts)) for d in docs.collect() for c in pt.ngrams(words(d.text))}


def test_pruning_agrees_with_one_document_at_a_time(spark, docs):
    found = corpus.candidates(docs).cache()
    kept = {(r.doc_id, r.pattern, r.n) for r in corpus.without_subsumed(found).collect()}
    values = {(r.doc_id, r.pattern): r.score for r in corpus.by_own_value(found).collect()}
    want, scores = set(), {}
    for d in docs.collect():
        own = pt.ngrams(words(d.text))
        want |= {(d.doc_id, " ".join(c.tokens), len(c.starts)) for c in pt.without_subsumed(own)}
        scores |= {(d.doc_id, " ".join(c.tokens)): s for c, s in pt.by_own_value(own)}
    assert kept == want
    assert values.keys() == scores.keys() and all(values[k] == pytest.approx(scores[k], abs=1e-6) for k in values)
    doubled = corpus.deduplicated(found.unionByName(found))
    assert {(r.doc_id, r.pattern, r.n) for r in doubled.collect()} == {(r.doc_id, r.pattern, r.n) for r in found.collect()}


def test_coding_tables(spark, docs):
    coded = corpus.encode(docs).cache()
    back = {r.doc_id: r.text for r in corpus.decode(coded.filter("doc_id <> 106")).collect()}
    assert back == {d.doc_id: " ".join(words(d.text)) for d in docs.collect() if d.doc_id != 106}
    m = {r.doc_id: r for r in corpus.metrics(coded).collect()}
    assert m[100].compression_ratio == 1.0 and all(r.compression_ratio <= 1 for r in m.values())
    assert {r.doc_id for r in corpus.reserved(docs).filter("reserved").collect()} == {106}
    entries = F.create_map(F.lit("<M>"), F.array(F.lit("a"), F.lit("<N>")), F.lit("<N>"), F.array(F.lit("b")))
    assert spark.range(1).select(corpus.expanded(F.array(F.lit("<M>"), F.lit("c")), entries, 2).alias("x")).first().x == ["a", "b", "c"]


def test_chunks(spark, docs):
    parts = chunks.chunked(docs, 16, 4)
    back = {r.doc_id: r.text for r in chunks.reassembled(parts, 4).collect()}
    assert back == {d.doc_id: " ".join(words(d.text)) for d in docs.collect() if words(d.text)}
    own = chunks.Chunker(100, 10)
    tokens = [f"t{i % 23}" for i in range(777)]
    done = [c.stream for i in range(0, 777, 50) for c in own.add(tokens[i : i + 50])]
    done += [c.stream for c in own.flush()]
    assert chunks.joined(done, 10) == tokens and own.tokens_in == 777
    with pytest.raises(RuntimeError):
        list(own.add(["x"]))
    for bad in ((99, 0), (100, 100), (100, -1)):
        with pytest.raises(ValueError):
            chunks.Chunker(*bad)


def test_preprocessing(spark, docs):
    kept = {r.doc_id: r.n_tokens for r in shared.preprocessed(docs, 1).collect()}
    texts = {}
    for d in docs.collect():
        texts.setdefault(d.text or "", d.doc_id)
    assert kept == {i: len(words(t)) for t, i in texts.items() if words(t)}
    assert shared.preprocessed(docs.limit(0)).collect() == []


def test_one_row_of_each_text(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (2, "a", "y"), (None, "b", "x"), (None, "b", "z"), (5, "b", "q"), (None, "c", "x"), (7, None, "x"), (6, "", "x"), (8, "d", "w"), (8, "d", "v")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, hash string")
    kept = [tuple(r) for r in shared.without_duplicates(docs).collect()]
    assert sorted(map(str, (r[:2] for r in kept))) == sorted(map(str, [(1, "a"), (5, "b"), (None, "c"), (6, ""), (8, "d")]))
    assert shared.without_duplicates(docs).columns == docs.columns and shared.without_duplicates(docs.limit(0)).collect() == []
    assert {(r.doc_id, r.copies) for r in shared.duplicates(docs).collect()} == {(1, 3), (5, 3), (None, 1), (6, 2), (8, 2)}


def test_saved_cache(spark, docs, tmp_path):
    path = str(tmp_path / "cache")
    cache = shared.learned(None, corpus.candidates(docs), 3)
    assert shared.load_cache(spark, path) is None
    shared.save_cache(cache, path)
    back = shared.load_cache(spark, path)
    assert back.columns == cache.columns and back.exceptAll(cache).isEmpty() and back.count() == cache.count() > 5
    shared.save_cache(back, path)  # over itself
    assert shared.load_cache(spark, path).count() == cache.count()
    for broken in ('{"pattern": "a b", "leng', '{"pattern": "a b", "version": 1}', json.dumps(cache.first().asDict() | {"version": 2})):
        (tmp_path / "bad").mkdir(exist_ok=True)
        (tmp_path / "bad" / "x.json").write_text(broken + "\n")
        assert shared.load_cache(spark, str(tmp_path / "bad")) is None


def test_alert_manager(spark):
    summaries = quality.summary(records(spark), ["k"])
    own, seen = alerting.Manager([("records", 1, 2)], 10, ["k"]), []

    def fails(rows):
        raise RuntimeError

    own.subscribe(fails)
    own.subscribe(lambda rows: seen.append(rows.count()))
    assert own.check(summaries, 0).count() == 2 and own.check(summaries, 5).count() == 0 and own.check(summaries, 10).count() == 2
    own.clear()
    assert own.check(summaries, 11).count() == 2 and seen == [2, 0, 2, 2]
    own.add_rule("compression_ratio_mean", 0.1, 0.9)
    assert {r.metric for r in own.check(summaries, 12).collect()} == {"compression_ratio_mean"}
    own.remove_rule("records")
    own.remove_rule("compression_ratio_mean")
    assert own.check(summaries, 99).collect() == []
    assert alerting.rules_from({"overhead_warning": 0.3, "overhead_critical": 0.5, "degradation_warning": 1}) == [("overhead_mean", 0.3, 0.5)]


def test_discovery_in_sql(spark, docs):
    stages.register(spark, "found", {"exact": pt.ngrams})
    docs.createOrReplaceTempView("docs_here")
    got = {(r.doc_id, r.pattern, r.n) for r in spark.sql("SELECT d.doc_id, p.* FROM docs_here d, LATERAL found(d.text) p").collect()}
    assert got == {(r.doc_id, r.pattern, r.n) for r in corpus.candidates(docs).collect()}
    stages.register(spark, "own", {"first": lambda words, config: [pt.Candidate(tuple(words[:2]), (0,), 7)]})
    assert spark.sql("SELECT * FROM own('x y z')").collect()[0].asDict() == {"stage": "first", "pattern": "x y", "length": 2, "n": 1, "starts": [0], "priority": 7}


def test_tools():
    own, tokens = Session(), "a b c d e".split() * 20
    ask = lambda method, **params: tools.handled(own, json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}))
    assert {t["name"] for t in ask("tools/list")["result"]["tools"]} == set(tools.TOOLS)
    done = json.loads(ask("tools/call", name="compress_tokens", arguments={"tokens": tokens})["result"]["content"][0]["text"])
    assert json.loads(ask("tools/call", name="decompress_tokens", arguments={"tokens": done["tokens"]})["result"]["content"][0]["text"])["tokens"] == tokens
    for name, arguments in (("analyze_compression", {"tokens": tokens}), ("compress_text", {"text": "x y " * 9}), ("compress_context", {"turns": ["a b", "c"]}), ("compress_streaming", {"tokens": tokens, "chunk": 100}), ("run_benchmark", {"n": 50, "runs": 1})):
        assert "result" in ask("tools/call", name=name, arguments=arguments), name
    for name in ("get_session_metrics", "get_historical_metrics", "get_quality_summary", "get_pattern_cache_stats", "clear_pattern_cache", "reset_session_metrics"):
        assert "result" in ask("tools/call", name=name), name
    assert [ask("tools/call", name="no")["error"]["code"], ask("tools/call", name="compress_text")["error"]["code"], ask("tools/call", name="run_benchmark", arguments={"k": 1})["error"]["code"], ask("nothing")["error"]["code"]] == [-32602, -32602, -32602, -32601]
    assert tools.handled(own, "{")["error"]["code"] == -32700 and tools.handled(own, "[]")["error"]["code"] == -32600
    assert tools.handled(own, {"method": "tools/list"}) is None and "result" in ask("initialize")


def test_similarity_and_reports(spark):
    rows = spark.createDataFrame([(0.7, 0.1, 0.1, 4.0, [1.0, 0.0], [1.0, 0.0]), (0.7, 0.1, 0.1, 4.0, [1.0, 0.0], [0.0, 2.0]), (0.35, 0.4, 0.5, 2.0, [0.0, 0.0], [1.0, 0.0])], "compression_ratio double, dict_share double, diversity_loss double, avg_pattern_length double, original_vector array<double>, coded_vector array<double>")
    got = quality.with_similarity(quality.sdk_score(rows, 0.5, 0.3, 0.4)).collect()
    assert [(r.similarity, r.decision) for r in got] == [(1.0, "accept"), (0.0, "accept"), (0.0, "skip")] and got[1].score == pytest.approx(1 - 0.85 * 0.3) and got[1].probability == pytest.approx(0.2)
    base = quality.baseline(records(spark), "compression_ratio")
    assert "p95" in sinks.baseline_report(base).first().text
    s = quality.summary(records(spark))
    parts = [r.text for r in sinks.health_report(s, quality.alerts(s, [("records", 1, 2)]), base).orderBy("ord").collect()]
    assert "degraded" in parts[0] and len(parts) == 4 and "healthy" in sinks.health_report(s, quality.alerts(s, [("records", 1000, 2000)])).orderBy("ord").first().text


def test_token_ids(spark):
    rows = spark.createDataFrame([(["1", "20"],), (["1", "-2"],), (["x"],), (["1.5"],), ([],), (None,)], "t array<string>")
    assert [r.ids for r in rows.select(whole_numbers(F.col("t")).alias("ids")).collect()] == [[1, 20], None, None, None, [], None]


def test_templates_and_passes(spark, docs):
    framed = " ".join(f"open file number {i} for reading now" for i in range(12))
    table = docs.filter("doc_id <> 106").unionByName(spark.createDataFrame([(200, framed)], "doc_id bigint, text string"))
    for config in (Config(templates=True), Config(discard_poor_pass=True), Config(selection="ilp", ilp_patterns=2), Config(selection="semantic", importance=True)):
        embed = embeddings.Hashed(8).embed if config.selection == "semantic" else None
        assert corpus.encode(table, config, embed).filter("not passed or passed is null").count() == 0
        assert {r.doc_id: r.text for r in corpus.round_trip(table, config, embed).collect()} == {r.doc_id: " ".join(words(r.text)) for r in table.collect()}
    plain, own = (corpus.encode(table, c).filter("doc_id = 200").first().n_coded for c in (Config(pool=1), Config(pool=1, templates=True)))
    assert own <= plain
    stream = templates.encode(words(framed), Config(templates=True))
    assert Config().slot in stream and codec.decode(stream, Config(templates=True)) == words(framed)


def test_static_dictionary(spark, docs):
    found = shared.static_dictionary(docs, entries=5).orderBy("rank").collect()
    assert [r.meta for r in found] == [f"<SD_{i}>" for i in range(5)]
    assert [r.score for r in found] == sorted((r.score for r in found), reverse=True)
    whole = offline.analysed(docs, embeddings.Hashed(16), entries=4, clusters=3)
    assert len(offline.as_static(whole)) == 4


def test_cache(spark, docs):
    found = corpus.candidates(docs).cache()
    once = shared.learned(None, found, 0)
    twice = shared.learned(once, found, 1)
    a = {r.pattern: r for r in once.collect()}
    assert all(r.occurrences == 2 * a[r.pattern].occurrences and r.last_seen == 1 and r.first_seen == 0 for r in twice.collect())
    assert shared.learned(None, found, 0, most=10).count() == 8
    warm = shared.warm_start(docs, once, 1, top=5).collect()
    assert warm and all(r.hits >= 2 for r in warm)
    n = once.count()
    bits = shared.bloom(once, "pattern", n)
    assert shared.maybe_in(once, "pattern", bits, n).count() == n
    other = spark.createDataFrame([(f"never {i}",) for i in range(200)], "pattern string")
    assert shared.maybe_in(other, "pattern", bits, n).count() < 20
    assert shared.known_patterns(other, once).count() == 0


def test_domains(spark):
    texts = {1: "def f ( self ) : return self", 2: "{ a : 1 , b : 2 }", 3: "allow the user to read , deny every other user of this resource", 4: "nothing in here", 5: None}
    got = {r.doc_id: (r.domain, r.confidence) for r in domains.detect(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    for i, t in texts.items():
        name, sure = domains.detected(words(t))
        assert got[i] == (name, pytest.approx(sure, abs=1e-6))
    assert [got[i][0] for i in (1, 2, 3, 4)] == ["code-python", "json", "security-policy", None]


def test_regions_of_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", 3), (1, 1, "user", 2), (1, 2, "assistant", 4), (1, 3, "robot", 1)], "conv_id bigint, turn bigint, role string, n_tokens bigint")
    found = regions.of_turns(turns)
    assert {(r.kind, r.start, r.end) for r in found.collect()} == {("user", 0, 5), ("assistant", 5, 9), ("unknown", 9, 10)}
    points = spark.createDataFrame([(1, 4), (1, 5), (1, 9), (1, 10), (2, 0)], "conv_id bigint, at bigint")
    assert {(r.conv_id, r.at): r.kind for r in regions.located(points, found, "conv_id", "at").collect()} == {(1, 4): "user", (1, 5): "assistant", (1, 9): "unknown", (1, 10): None, (2, 0): None}


def test_quality(spark):
    row = dict(doc_id=1, n_tokens=1000, n_coded=250, n_body=100, n_patterns=20, pattern_tokens=40, distinct_tokens=500, distinct_body=60, covered=800)
    low = row | dict(doc_id=2, n_coded=950, n_body=900, n_patterns=5, distinct_body=480)
    found = quality.predicted(quality.features(spark.createDataFrame([row, low])))
    bad, good = found.orderBy("doc_id").collect()
    assert bad.degradation == pytest.approx(0.15 * 0.25 + 0.2 * 0.05 + 0.03 + 0.02 + 0.03 + 0.02) and bad.recommendation == "skip"
    assert good.degradation == 0 and good.recommendation == "compress" and good.risks == []
    assert quality.worthwhile(found).count() == 1
    harder = quality.predicted(quality.features(spark.createDataFrame([row])), "code", cautious=True).first()
    assert harder.degradation == pytest.approx(bad.degradation * 1.5 * 1.3)
    sdk = spark.createDataFrame([(0.35, 0.4, 0.5, 2.0), (0.7, 0.1, 0.1, 4.0)], "compression_ratio double, dict_share double, diversity_loss double, avg_pattern_length double")
    assert [r.decision for r in quality.sdk_score(sdk, 0.5, 0.3, 0.4).collect()] == ["skip", "accept"]


def records(spark):
    return spark.createDataFrame([(i, i / 100, 0.01, 0.1, 3, 100, 50, i != 7, float(i % 2), "ab"[i % 2]) for i in range(100)], "ts int, compression_ratio double, degradation double, overhead double, patterns_used int, original_length int, compressed_length int, passed boolean, latency_ms double, k string")


def test_monitoring(spark):
    rows = records(spark)
    s = quality.summary(rows, exact=True).first()
    assert s.records == 100 and s.compression_ratio_p50 == pytest.approx(0.495) and s.failure_rate == 0.01 and s.tokens_saved == 5000 and s.latency_mean == 1.0
    raised = {r.metric: r.severity for r in quality.alerts(quality.summary(rows)).collect()}
    assert raised == {"compression_ratio_p95": "warning", "failure_rate": "warning"}
    assert quality.alerts(quality.summary(rows), [("compression_ratio_mean", 0.6, 0.5)], below=True).first().severity == "critical"
    base = quality.baseline(rows, "compression_ratio")
    assert base.first().n == 100 and base.first().p95 == 0.95
    assert quality.baseline(rows.limit(5), "compression_ratio").collect() == []
    assert quality.anomalies(rows, base, "compression_ratio", 1.7).count() == 2
    assert [r.n for r in quality.histogram(rows, "ts").orderBy("bin").collect()] == [10] * 10
    assert quality.histogram(rows, "overhead").first().n == 100 and quality.histogram(rows.limit(0), "ts").collect() == []
    assert quality.rolling(rows, "ts", "k", "ts", 3).orderBy("ts").collect()[-1].rolling_mean == 97.0
    cooled = quality.cooled(spark.createDataFrame([("m", 0), ("m", 5), ("m", 10), ("n", 3)], "metric string, ts int"), 10)
    assert {(r.metric, r.ts) for r in cooled.collect()} == {("m", 0), ("m", 10), ("n", 3)}
    ops = spark.createDataFrame([("compress", 100, 60, 40.0, 10.0, True), ("analyze", 100, 120, -20.0, 10.0, True), ("decompress", 5, 9, 0.0, 1.0, True), ("compress", 1, 1, 0.0, 1.0, False)], "operation string, input_tokens int, output_tokens int, savings_percent double, time_ms double, success boolean")
    t = quality.session(ops).first()
    assert (t.compressions, t.decompressions, t.errors, t.tokens_saved, t.savings_best) == (2, 1, 1, 40, 40.0)


def test_reports(spark, tmp_path):
    s = quality.summary(records(spark), ["k"])
    lines = [r.line for r in sinks.prometheus(s, keys=["k"]).orderBy("ord").collect()]
    assert lines[0].startswith("# HELP motifloom_records") and 'motifloom_records{k="a"} 50.0' in lines
    assert "records" in sinks.report(s.drop("k")).first().text
    assert "CRITICAL" in sinks.alert_report(quality.alerts(s, [("records", 1, 2)], keys=["k"])).first().text
    assert sinks.histogram_report(quality.histogram(records(spark), "ts")).count() == 10
    sinks.json_lines(s, str(tmp_path / "log"), 5)
    sinks.json_lines(s, str(tmp_path / "log"), 6)
    assert sorted({r.timestamp for r in spark.read.json(str(tmp_path / "log")).collect()}) == [5, 6]
    hits = spark.createDataFrame([(3, 1)], "hits int, misses int")
    sinks.cache_lines(hits, str(tmp_path / "hits"), 1)
    sinks.combined_lines({"a": hits, "b": hits}, str(tmp_path / "both"), 1)
    assert spark.read.json(str(tmp_path / "hits")).first().hit_rate == 0.75 and spark.read.json(str(tmp_path / "both")).first().b.hits == 3


def test_corpora(spark, tmp_path):
    rows = [{"id": "a", "text": "x y", "domain": "code", "tags": ["t"], "token_count": 2}, {"id": "b", "text": "z", "domain": "policy", "extra": 1}]
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "d.jsonl").write_text("\n\n".join(map(json.dumps, rows)) + "\n")
    got = corpora.json_lines(spark, str(tmp_path / "in" / "deep" / "d.jsonl")).orderBy("id").collect()
    assert [(r.id, r.tags) for r in got] == [("a", ["t"]), ("b", [])]
    assert corpora.directory(spark, str(tmp_path / "in")).count() == 2
    (tmp_path / "in" / "manifest.json").write_text(json.dumps({"domains": {"x": {"y": {"path": "deep/d.jsonl"}}}}))
    assert corpora.directory(spark, str(tmp_path / "in")).count() == 2
    column = spark.createDataFrame([(json.dumps(r),) for r in [*rows, {"id": "c"}]], "j string")
    assert corpora.from_json_column(column, "j", strict=False).count() == 2
    with pytest.raises(Exception, match="lacks text, domain"):
        corpora.from_json_column(column, "j").collect()


def test_embedding_table(spark, docs):
    own = embeddings.Hashed(8)
    first = embeddings.embedded(embeddings.keyed(docs.limit(5), own.name), own)
    cache = first.select("cache_key", "embedding").withColumns({"created_at": F.lit(0), "access_count": F.lit(1), "last_accessed": F.lit(0)})
    found = embeddings.with_cache(docs, cache, own)
    rate = embeddings.hit_rate(found).first()
    assert rate.hits + rate.misses == docs.count() and rate.hits >= 5
    after = embeddings.updated(cache, found, 9, 10**6)
    assert after.filter("last_accessed = 9").count() == after.count()
    assert embeddings.updated(cache, found, 9, 10).count() == after.count() - max(1, after.count() // 10)
    assert embeddings.provider_or_none("nothing") is None and embeddings.provider("ollama").name
    with pytest.raises(ValueError):
        embeddings.provider("nothing")


def test_tokenizers(spark, docs):
    assert tokenizers.tokenized(docs).filter("doc_id = 105").first().tokens == "a b a b a b a b a b".split()
    own = tokenizers.tokenized(docs, tokenizers.Whitespace)
    assert own.filter("doc_id = 105").first().tokens == "a b a b a b a b a b".split()


def test_training(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a b c"), (1, 1, "assistant", "d e"), (2, 0, "assistant", "x")], "conv_id bigint, turn bigint, role string, text string")
    assert [(r.n_input, r.n_target) for r in shared.training_examples(turns).collect()] == [(5, 2)]
    one = spark.createDataFrame([(["a"], ["b", "c"])], "prompt array<string>, target array<string>")
    assert shared.with_loss_mask(one).first().loss_mask == [0, 1, 1]
    assert [n for n, _, _ in shared.curriculum()] == ["baseline", "intermediate", "advanced"]
    assert shared.vocabulary(spark, Config(fuzzy=True, static_auto=True)).count() == 507


def test_mean_cosine(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 2.0]), (0, [3.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0]), (2, [1.0, 0.0])]
    got = {r.label: r.similarity for r in shared.mean_cosine(spark.createDataFrame(rows, "label int, embedding array<double>"), "label").collect()}
    assert got == {0: pytest.approx(1 / 3), 1: 1.0, 2: pytest.approx(0.0)}


def test_coded_stream(spark, tmp_path):
    folder = str(tmp_path / "pieces")
    tokens = [f"t{i % 17}" for i in range(450)]
    pieces = [(s, k, " ".join(tokens[k * 90 : k * 90 + 90]), k == 4) for s in (1, 2) for k in range(5)]
    schema = "stream_id bigint, seq bigint, text string, last boolean"
    spark.createDataFrame(pieces, schema).coalesce(1).write.parquet(folder)
    out = chunks.coded_stream(corpora.stream(spark, folder, schema), 200, 20)
    query = out.writeStream.format("memory").queryName("coded").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    for s in (1, 2):
        done = [r.coded.split(" ") for r in spark.table("coded").filter(F.col("stream_id") == s).orderBy("chunk").collect()]
        assert len(done) == 3 and chunks.joined(done, 20) == tokens


def test_learning_stream(spark, docs, tmp_path):
    folder = str(tmp_path / "found")
    corpus.candidates(docs).select("pattern", "length", "n").coalesce(1).write.parquet(folder)
    query = monitor.learning(corpora.stream(spark, folder, "pattern string, length bigint, n bigint"), str(tmp_path / "state"), str(tmp_path / "table"))
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "table/0")).count() == corpus.candidates(docs).select("pattern").distinct().count()


def test_windows(spark):
    rows = spark.createDataFrame([(i % 2, i * 60, float(i)) for i in range(120)], "k int, s int, value double").withColumn("ts", F.timestamp_seconds("s"))
    assert monitor.windowed(rows, "value").count() == 2 and monitor.windowed(rows, "value", slide="30 minutes").count() == 5
    assert monitor.sessions(rows, "k", gap="5 minutes").count() == 2


def test_service():
    own = Session()
    tokens = "a b c d e".split() * 20
    done = own.compress_tokens(tokens)
    assert own.decompress_tokens(done["tokens"])["tokens"] == tokens and done["savings_percent"] > 50
    assert own.analyze(tokens)["recommendation"] == "highly_recommended" and len(own.analyze(tokens)["top_patterns"]) <= 10
    context = own.compress_context([" ".join(tokens), "hello there", "last one"], preserve_recent=2)
    assert context["recent"] == "hello there last one".split()
    assert own.compress_text(" ".join(tokens))["output_tokens"] == done["output_tokens"]
    assert own.compress_streaming(tokens, 100)["chunks"]
    assert own.session_metrics()["compressions"] == 6 and own.quality_summary()["health"] == "excellent"
    assert own.benchmark(200, 1)["ratio"] <= 1 and own.cost(1_000_000)["basic"] == 0.5
    assert own.pattern_cache_stats()["patterns"] > 0 and own.clear_pattern_cache() > 0
    own.reset_session_metrics()
    assert own.quality_summary() == {"status": "no_data"} and own.historical_metrics() == []
    for bad in (lambda: own.compress_tokens([]), lambda: own.compress_text("x" * 500_001), lambda: own.benchmark(10**6)):
        with pytest.raises(ValueError):
            bad()


def test_every_query_has_rows_or_a_schema(spark):
    import __spark_entry__ as entry

    found = entry.queries()
    assert set(entry.oracle_sql()) <= set(found)
    assert entry.entry(spark).columns == ["doc_id", "pattern", "length", "n"]
