"""The pipeline: what each stage keeps, over tables with planted cases."""

import glob
import os
import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from motifloom.llm import kernels, quality, secret_scan, source_mix
from motifloom.sources.storage import shared_folder

from .helpers import documents, odd, text
from .test_maps import brute_overlaps, brute_secrets
from .test_mix_and_search import sql
from .test_near_dedup import brute as brute_copies

SECRET = "AKIA" + "Q7ZP3MX5WT2KBN4J"


def folder(spark, tmp_path):
    rng = random.Random(41)
    good = {i: text(rng, rng.randrange(60, 200)) + ("." if i % 4 else f" key = {rng.randrange(10**9)} ID A{i}.") for i in range(240)}
    junk = {1000 + i: " ".join(rng.choice(["$$$", "###", "| |", "***", "@@"]) + rng.choice("xyz") for _ in range(80)) for i in range(60)}
    passage = text(rng, 40)
    planted = {500: good[3], 501: " ".join(good[5].split()[:-1] + ["changed"]), 502: text(rng, 80) + " " + passage + " " + text(rng, 50), 503: text(rng, 80) + " " + SECRET + " " + text(rng, 60)}
    rows = [(i, t, f"src{i % 3}") for i, t in (good | junk | planted).items()]
    docs = documents(spark, rows)
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in good] + [(i, 0, 0) for i in junk]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage), (2, text(rng, 30))], "item_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), good, junk, planted


def test_planted_cases(spark, tmp_path):
    sf, good, junk, planted = folder(spark, tmp_path)
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{sf}/stage-{name}")
        docs = spark.read.parquet(f"{sf}/stage-{name}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns if k < len(corpus_pipeline.STAGES) - 1 else docs.columns[: len(columns)] == columns
    assert not set(junk) & set(kept["quality"]) and set(good) <= set(kept["quality"])
    near = set(kept["near_duplicates"])
    assert len(near & {3, 500}) == 1 and len(near & {5, 501}) == 1 and set(good) - {3, 5} <= near
    assert near - set(kept["decontamination"]) == {502}
    assert set(kept["secrets"]) == set(kept["decontamination"])
    cleaned = kept["secrets"][503]
    assert "AKIA" not in cleaned.text and "[aws_key_id]" in cleaned.text and cleaned.n_chars == len(cleaned.text)
    assert all(kept["secrets"][i].text == good[i] for i in near & set(good))
    assert set(kept["mix"]) == set(kept["secrets"])
    whole = corpus_pipeline.run(spark, sf)
    key = lambda r: (r.doc_id, r.mix_epoch, r.mix_position, r.text)
    assert sorted(map(key, whole.collect())) == sorted(map(key, docs.collect()))


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "mix"]


def test_odd_rows_pass_all_stages(spark, tmp_path):
    docs = odd(spark)
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (None, "")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).filter("mix_epoch = 0").collect()
    # without labels all are kept; of the copies 4, 4 and 5 one stays, and the row without an id
    assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 2, 3, 4, 6, 7, 8, 9]
    for stage in corpus_pipeline.STAGES:
        assert stage[1](spark, docs.limit(0), str(tmp_path)).collect() == []


def test_run_matches_brute_force(spark, tmp_path):
    """All stages again in plain Python and SQL: every pair of texts, every diagonal, every rule at every offset."""
    sf, *_ = folder(spark, tmp_path)
    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").filter("pmod(xxhash64(doc_id), 5) = 0").collect()}

    x = quality.statistics(kernels.as_strings(pa.array([rows[i].text for i in ids])))
    fit, own = (np.array([i in labels and (i in held) == h for i in ids]) for h in (False, True))
    y = np.array([labels.get(i, 0) for i in ids], dtype=float)
    mean, scale, k = x[fit].mean(0), x[fit].std(0) + quality.LEAST_SCALE, quality.FEATURES + 1
    rng = np.random.default_rng(quality.SEED)
    direction, phase = rng.normal(0, 1 / quality.BANDWIDTH, (x.shape[1], k - 1)), rng.uniform(0, 2 * np.pi, k - 1)
    z = quality.fourier((x - mean) / scale, direction, phase)
    weight = np.linalg.lstsq(np.vstack([z[fit], np.sqrt(quality.RIDGE * fit.sum() / k) * np.eye(k)]), np.concatenate([y[fit], np.zeros(k)]), rcond=None)[0]
    cells = quality.cell(z @ weight)
    curve = quality.isotonic(np.bincount(cells[own], minlength=quality.GRID), np.bincount(cells[own], weights=y[own], minlength=quality.GRID))
    left = [(i, rows[i].text) for i, c in zip(ids, cells) if round(curve[c], 6) >= quality.KEEP]

    gone = {i for i, _ in brute_copies(left)}
    left = [(i, t) for i, t in left if i not in gone]
    bad = {i for i, _ in brute_overlaps(left, items)}
    left = [(i, secret_scan.redacted(t, brute_secrets(t))) for i, t in left if i not in bad]
    docs = documents(spark, [(i, t, rows[i].source) for i, t in left])
    want = sql(source_mix.ORACLE_SQL, documents=docs)

    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.source, r.mix_epoch, round(r.mix_position, 8)) for r in got) == sorted((d, s, e, round(p, 8)) for d, s, _, e, p in want)
    assert {(r.doc_id, r.text) for r in got} == set(left) and gone and bad and len(left) < len(ids) - 60
    assert len(os.listdir(sorted(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/pipeline-*"), key=os.path.getmtime)[-1])) == 1
