"""Exact search against all products, and the pipeline against its operators."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import vector_search
from siltstone.llm.queries import ORACLE_SQL, QUERIES
from test_near_dup import brute


def brute_top(rows, k, every):
    """(query, rank, id, score) by plain integers."""
    valid = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            valid.append((i, [int(np.floor(64 * float(x))) for x in v]))
    out = set()
    for i, q in {(i, tuple(v)) for i, v in valid if i % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in valid if j != i)[:k]
        out |= {(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)}
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<float>, label int, score int")


def cases():
    rng = np.random.default_rng(3)
    clustered = np.repeat(rng.normal(0, 0.4, (40, 16)), 10, axis=0) + rng.normal(0, 0.02, (400, 16))
    yield "clustered", [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(clustered)], 20
    tied = rng.integers(-1, 2, (90, 4)) / 64
    yield "ties", [(i, v.tolist()) for i, v in enumerate(tied)] + [(7, [0.5, 0.5, 0.5, 0.5])] * 3, 10
    awkward = [(0, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (None, [1.0, 1.0]), (6, [0.25]), (7, []), (8, [-1.0, -1.0, 3.0]), (-10, [0.5, 0.5])]
    yield "awkward", awkward, 20
    huge = [(i, [float(np.float32(x)) for x in rng.normal(0, 10.0**e, 3)]) for i, e in enumerate((1, 3, 5, 6, 6, 7, 2, 7, 0, 5, 4, 6, 7, 1, 2, 3, 4, 5, 6, 7, 7))]
    yield "large", huge, 5


@pytest.mark.parametrize("case", list(cases()), ids=lambda c: c[0])
def test_top_k_is_brute_force(spark, case, monkeypatch):
    _, rows, k = case
    got = vector_search.top_k(table(spark, rows).repartition(3), F.col("vec_id") % 2 == 0, k).collect()
    assert {tuple(r) for r in got} == brute_top(rows, k, 2)
    assert len(got) == len({tuple(r) for r in got})


def test_both_zeros_and_padding_are_one_query(spark):
    rows = [(0, [0.0, 1.0]), (0, [-0.0, 1.0]), (0, [-0.0, 1.0, 0.0, -0.0]), (3, [1.0, 0.5]), (5, [0.25, -1.0])]
    got = vector_search.top_k(table(spark, rows).repartition(5), F.col("vec_id") % 2 == 0, 5).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 3, 2048), (0, 2, 5, -4096)]


def test_many_shards_and_query_groups(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "QUERY_GROUP", 20)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 0.3, (300, 8)).astype(np.float32))]
    got = vector_search.top_k(table(spark, rows).repartition(7), F.col("vec_id") % 3 == 0, 6).collect()
    assert {tuple(r) for r in got} == brute_top(rows, 6, 3)


def test_blocks_are_pruned_on_alike_vectors():
    rng = np.random.default_rng(1)
    m = np.floor(64 * (np.repeat(rng.normal(0, 0.5, (64, 32)), 64, axis=0) + rng.normal(0, 0.01, (4096, 32))))
    shard = vector_search.read_shard(vector_search.shard_bytes(np.arange(4096), m))
    best = vector_search.TopK(100, 10)
    scored = vector_search.search_shard(np.arange(100) * 40, m[::40][:100], shard, best, 0)
    assert scored < 0.5 * 100 * 64


def test_empty_vectors(spark):
    assert vector_search.top_k(table(spark, []), F.col("vec_id") % 2 == 0).isEmpty()
    assert vector_search.top_k(table(spark, [(1, [0.5])]), F.col("vec_id") % 2 == 0).isEmpty()
    ids, m = vector_search.quantised(pa.array([], pa.int64()), pa.array([], pa.list_(pa.float32())))
    assert len(ids) == 0 and m.shape == (0, 0)


def test_names():
    numbers = [int(re.match(r"op(\d+)_", x)[1]) for x in QUERIES]
    assert numbers == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "language_identification", "near_deduplication", "secret_removal", "sequence_packing"]


def test_pipeline_stages(spark, data):
    """Each stage's decisions by a plain version on the stage's own input."""
    from siltstone.llm import language_id, quality
    from siltstone.llm._runtime import crc32_bucket, materialize

    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, data), "test")
        before = {r.doc_id: r for r in docs.collect()}
        after = {r.doc_id: r for r in out.collect()} if name != "sequence_packing" else None
        if after is not None:
            assert out.columns == docs.columns
        if name == "quality_classifier":
            model = quality.fit(docs, labels.where(crc32_bucket("doc_id", 5) != 0))
            assert set(after) == {r.doc_id for r in quality.score_quality(docs, model).where("score >= 0.3").collect()}
            good = {r.doc_id for r in labels.where("quality = 1").collect()}
            assert len(good & set(after)) >= 0.95 * len(good)
        elif name == "language_identification":
            assert len(after) >= 0.99 * len(before)
        elif name == "near_deduplication":
            _, roots = brute([(i, r.text) for i, r in before.items()], 5, 80)
            assert set(after) == {i for i, root in roots.items() if i == root}
        elif name == "secret_removal":
            assert set(after) == set(before)
            changed = [i for i in after if after[i].text != before[i].text]
            assert all("removed]" in after[i].text and after[i].n_chars == len(after[i].text) for i in changed)
            assert not any(re.search("[0-9a-f]{16}", r.text or "") for r in after.values())
        else:
            assert {r.doc_id for r in out.collect()} == set(before)
        kept[name] = out.count()
        docs = out
    assert corpus_pipeline.run(spark, data).count() == kept["sequence_packing"]


def test_pipeline_of_awkward_rows(spark, tmp_path):
    """Nulls in every column, repeated ids, copies, a very long text; and no rows at all."""
    from helpers import TEXTS

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    english = [f"the quick brown fox number {i} jumps over the lazy dog and runs {i % 7} times" for i in range(30)]
    german = [f"der schnelle braune fuchs nummer {i} springt über den faulen hund und rennt {i % 7} mal" for i in range(30)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(english)] + [(100 + i, t, "de", None, None) for i, t in enumerate(german)]
    rows += [(None, t, None, None, None) for t in TEXTS] + [(200 + i, t, None, "s", 1) for i, t in enumerate(TEXTS)] + rows[:3] + [(0, "another text of the same id", "en", "s", 1)]
    for name, own in (("full", rows), ("none", [])):
        where = str(tmp_path / name)
        spark.createDataFrame(own, schema).write.parquet(f"{where}/documents.parquet")
        labels = [(i, 1, 0) for i in range(0, 130)] + [(5, 0, 0), (None, 1, None), (7, None, None)]
        spark.createDataFrame(labels if own else [], "doc_id bigint, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
        docs = spark.read.parquet(f"{where}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, docs, where)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            out.write.parquet(f"{where}/{stage}")
            docs = spark.read.parquet(f"{where}/{stage}")
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, where).collect()
        assert bool(pieces) == bool(own)
        if own:
            ids = [r.doc_id for r in docs.where("doc_id IS NOT NULL").collect()]
            # The id that comes with two texts is two documents.
            assert len(ids) == len(set(ids)) + 1 and ids.count(0) == 2 and len(set(ids) & set(range(130))) >= 55
