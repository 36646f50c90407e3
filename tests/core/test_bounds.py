"""Plans and kernels whose needs don't grow with the table."""

import pyarrow as pa
from pyspark.sql.classic.dataframe import DataFrame

from motifloom.config import Config
from motifloom.operators import corpus

WORDS = "the quick brown fox sees the quick brown dog and the quick brown fox runs "


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_declared_candidates_are_neither_shuffled_nor_sorted(spark, monkeypatch):
    monkeypatch.setattr(corpus, "FEW_BYTES", 0)
    docs = spark.createDataFrame([(1, WORDS * 3), (2, "a b"), (3, None), (4, "x x x x x x x x x x x"), (None, WORDS * 2)], "doc_id bigint, text string")
    found = corpus.candidates_declared(docs)
    assert not [x for x in ("Exchange", "Sort ", "Window", "Aggregate") if x in plan(found)]
    for config in (Config(), Config(min_length=3, max_length=5), Config(max_length=2), Config(length_tokens=False)):
        own, kernel = (sorted(f(docs, config).select("doc_id", "pattern", "length", "n", "starts").collect(), key=str) for f in (corpus.candidates_declared, corpus.candidates))
        assert own == kernel
        assert own


def test_declared_candidates_of_rows_with_one_id_are_found_row_by_row(spark):
    docs = spark.createDataFrame([(7, "a b c " * 4), (7, "c b a " * 4)], "doc_id bigint, text string")
    own, kernel = (sorted(f(docs).select("pattern", "n", "starts").collect()) for f in (corpus.candidates_declared, corpus.candidates))
    assert own == kernel


def kernels(spark, monkeypatch, build):
    """The kernels that ``build`` maps over tables."""
    found, plain = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, *more: (found.append(f), plain(self, f, *more))[1])
    build(spark.createDataFrame([(1, WORDS)], "doc_id bigint, text string"))
    return found


def test_results_are_passed_on_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(corpus, "BYTES", 100_000)
    ids, texts = list(range(400)), [" ".join((WORDS * 3).split())] * 400
    for build in (corpus.round_trip, corpus.encode, corpus.candidates, corpus.template_round_trip):
        (kernel,) = kernels(spark, monkeypatch, build)
        taken = []
        source = (taken.append(i) or pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([t])], names=["doc_id", "text"]) for i, t in zip(ids, texts))
        out, at = [], []
        for batch in kernel(source):
            out.append(batch)
            at.append(len(taken))
        # the first results leave long before the last text comes, and no row is lost
        assert at[0] < 300
        assert max(b.nbytes for b in out) < 100_000
        assert sorted(set(pa.Table.from_batches(out)["doc_id"].to_pylist())) == ids


def test_streams_are_decoded_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(corpus, "BYTES", 64 * 100)
    streams = [["a"] * n for n in (3, 0, 150, 60, 60, 1)] + [None]
    assert list(corpus._pieces(pa.array(streams, pa.list_(pa.string())))) == streams
    assert list(corpus._pieces(pa.array(streams, pa.list_(pa.string())).slice(2, 3))) == streams[2:5]
    docs = spark.createDataFrame([(i, WORDS * i) for i in range(6)] + [(9, None)], "doc_id bigint, text string")
    for config in (Config(), Config(fuzzy=True, max_length=6), Config(static_id="python-v1")):
        twice = {tuple(r) for r in corpus.decode(corpus.encode(docs, config), config).collect()}
        assert {(r.doc_id, r.text) for r in corpus.round_trip(docs, config).collect()} == twice


def test_coding_without_streams_gives_the_same_figures(spark):
    docs = spark.createDataFrame([(i, WORDS * i) for i in range(6)] + [(9, None)], "doc_id bigint, text string")
    whole, bare = corpus.encode(docs).drop("stream"), corpus.encode(docs, streams=False)
    assert whole.schema == bare.schema
    assert sorted(whole.collect(), key=str) == sorted(bare.collect(), key=str)
