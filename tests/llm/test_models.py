"""Language identification and quality scores: held-out accuracy and awkward rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import TEXTS, documents
from pyspark.sql import functions as F

from siltstone.llm import language_id, quality

from siltstone.llm.queries import op2_language_id, op10_quality
from test_near_dup import offsets

BIGGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def lang_model(spark, data):
    return language_id.fit(spark.read.parquet(f"{data}/documents.parquet"))


def grams(text):
    """N-grams of one text by plain slices."""
    low = [c.lower() if c.isalpha() else " " for c in text]
    out = [" "]
    for c in low:
        if not (c == " " and out[-1] == " "):
            out.append(c)
    if out[-1] != " ":
        out.append(" ")
    s = "".join(out)
    return sorted(s[i : i + n] for n in language_id.ORDERS for i in range(len(s) - n + 1))


def test_grams_of_a_batch_are_those_of_each_text():
    texts = ["", "the cat", "  a  b!! c ", "x", "Größe 12 naïve", None, "...", "end."]
    hashes, firsts, lettered = language_id.gram_hashes(*offsets(texts))
    assert lettered.tolist() == [any(c.isalpha() for c in t or "") for t in texts]
    for i, t in enumerate(texts):
        alone = language_id.gram_hashes(*offsets([t]))[0]
        own = hashes[firsts[i] : firsts[i + 1]]
        assert sorted(own.tolist()) == sorted(alone.tolist())
        assert len(own) == len([g for g in grams(t or "") if g.strip()])
        assert len(set(own.tolist())) == len({g for g in grams(t or "") if g.strip()})


def test_filter_finds_what_it_holds_and_little_else():
    texts = ["the quick brown fox jumps over the lazy dog"] * 4 + ["der schnelle braune fuchs springt über den faulen hund"] * 4
    model = language_id.train(texts, ["en"] * 4 + ["de"] * 4)
    assert model["wrong"].max() < 1e-6
    names, scores = language_id.predict(model, *offsets(["the lazy fox", "der faule hund", "", "123", None, "жжж"]))
    assert names[:5] == ["en", "de", "und", "und", "und"][:0] + ["en", "de", "und", "und", "und"] and names[5] in ("de", "en")
    assert scores[0] > 0.6 and scores[2] == scores[5] == 0


def test_more_than_64_languages():
    rng = random.Random(2)
    words = {f"l{k:02}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(20)] for k in range(70)}
    texts = [" ".join(w) for w in words.values()]
    model = language_id.train(texts, list(words))
    assert model["masks"].shape[0] == 2
    assert language_id.predict(model, *offsets(texts))[0] == list(words)


def test_language_accuracy(spark):
    out = op2_language_id(spark, BIGGER).join(spark.read.parquet(f"{BIGGER}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out AND lang IS NOT NULL")
    right, rows = held.where("lang = lang_pred").count(), held.count()
    assert rows > 250 and right >= 0.97 * rows
    assert out.where("score < 0 OR score > 1 OR isnan(score)").isEmpty()


def test_language_of_awkward_rows(spark, lang_model):
    docs = documents(spark, TEXTS, [*range(len(TEXTS) - 1), None])
    rows = {r.doc_id: r for r in language_id.identify(docs, lang_model).collect()}
    assert len(rows) == len(TEXTS)
    assert rows[0].lang_pred == rows[1].lang_pred == rows[2].lang_pred == "und" and rows[3].lang_pred != "und"
    kept = language_id.keep_identified(docs, lang_model, 0.0)
    assert kept.columns == docs.columns and kept.count() == sum(r.lang_pred != "und" for r in rows.values())
    assert language_id.identify(docs.limit(0), lang_model).isEmpty()


def test_no_training_rows(spark):
    none = language_id.fit(documents(spark, ["a b"]).withColumn("lang", F.lit(None).cast("string")))
    assert language_id.identify(documents(spark, ["some text"]), none).first().lang_pred == "und"
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.score_quality(documents(spark, ["some text"]), quality.fit(documents(spark, ["a"]), labels)).first().score == 0.5


def test_quality_accuracy(spark):
    out = op10_quality(spark, BIGGER).join(spark.read.parquet(f"{BIGGER}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(out) > 50
    assert sum(r.predicted == r.quality for r in out) >= 0.93 * len(out)
    good, bad = ([r.score for r in out if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_quality_of_awkward_rows(spark, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    source = spark.read.parquet(f"{data}/documents.parquet")
    model = quality.fit(source, labels.unionByName(labels.limit(5)).unionByName(labels.limit(3).withColumn("quality", F.lit(None).cast("int")), allowMissingColumns=True))
    assert model == quality.fit(source.repartition(5), labels), "training does not depend on the partitions"
    docs = documents(spark, TEXTS, [*range(len(TEXTS) - 1), None])
    rows = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    assert len(rows) == len(TEXTS) and all(0 <= x <= 1 for x in rows.values())
    assert rows[0] == rows[1] and rows[4] == rows[16]
    assert quality.keep_quality(docs, model, 0.3).count() == sum(x >= 0.3 for x in rows.values())
    assert quality.score_quality(docs.limit(0), model).isEmpty()


def test_languages_are_those_of_plain_sets(spark, data):
    """Predictions against sets of n-grams by language, without a filter, learned from the same texts."""
    rows = [r for r in spark.read.parquet(f"{data}/documents.parquet").select("text", "lang").collect() if r.text]
    learned = [r for r in rows if r.lang is not None]
    times = {}
    for r in learned:
        for g in grams(r.text):
            if g.strip():
                own = times.setdefault(r.lang, {})
                own[g] = own.get(g, 0) + 1
    rates = {x: {g: n / sum(own.values()) for g, n in own.items()} for x, own in times.items()}
    most = {}
    for own in rates.values():
        for g, r in own.items():
            most[g] = max(most.get(g, 0), r)
    member = {x: {g for g, r in own.items() if r >= language_id.RELATIVE * most[g]} for x, own in rates.items()}
    share = {x: sum(rates[x][g] for g in own) for x, own in member.items()}
    model = language_id.train([r.text for r in learned], [r.lang for r in learned])
    names, scores = language_id.predict(model, *offsets([r.text for r in rows]))
    exact = 0
    for r, name, score in zip(rows, names, scores):
        found = [g for g in grams(r.text) if g.strip()]
        support = {x: sum(g in own for g in found) / share[x] for x, own in member.items()}
        whole = sum(support.values())
        if not any(c.isalpha() for c in r.text):
            assert name == "und"
        elif whole:
            # A few n-grams of a text may be false positives of the filter.
            assert abs(score - max(support.values()) / whole) < 0.001 + 3 / len(found)
            assert support[name] >= max(support.values()) * 0.99 - 3
            exact += abs(score - max(support.values()) / whole) < 0.001
    assert exact > 0.9 * len(rows)


def test_every_gram_is_kept():
    """No n-gram is dropped however many a language has, and the filter grows with them."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöüßéèàñ", k=8)) for _ in range(30_000)]
    model = language_id.train([" ".join(words), "12 жжжж"], ["xx", "yy"])
    assert model["masks"].shape[1] > 1 << language_id.SLOT_BITS and model["wrong"].max() < 1e-3
    hashes = language_id.gram_hashes(*offsets([" ".join(words)]))[0]
    found = model["masks"][0][language_id._slots(hashes, 0, model["masks"].shape[1])]
    assert (found & 1).all()


def test_scores_are_vectors_and_layers_by_hand():
    """Scores against word vectors, means, layers and temperature in plain loops."""
    rng = random.Random(0)
    texts = [" ".join(rng.choices(["good", "fine", "text", "here"], k=30)) for _ in range(30)] + [" ".join(rng.choices(["bad###", "junk!!", "X|X"], k=30)) for _ in range(30)]
    texts += ["", "one"]
    index = quality.index_vectors()
    context = np.zeros((quality.BUCKETS, quality.DIMENSIONS))
    cut = []
    for t in texts:
        words, shapes, _, pooled = quality.buckets(*offsets([t]))
        cut.append((words, shapes, pooled[0]))
        for i in range(len(words)):
            for j in range(max(0, i - quality.WINDOW), min(len(words), i + quality.WINDOW + 1)):
                if j != i:
                    for b in (words[i], shapes[i]):
                        context[b] += index[words[j]] + index[shapes[j]]
    vectors = np.array([(c / np.linalg.norm(c) if c.any() else c) + 0.5 * v / quality.NONZERO**0.5 for c, v in zip(context, index)])
    x = []
    for words, shapes, pooled in cut:
        means = [np.mean([vectors[b] for b in own], axis=0) if len(own) else np.zeros(quality.DIMENSIONS) for own in (words, shapes)]
        x.append(np.concatenate((*means, pooled)))
    x = np.array(x)
    labels = [1] * 30 + [0] * 30 + [0, 1]
    model = quality.train(texts, labels)
    own = quality.train_network(vectors, x, np.array(labels, float), {0: 31, 1: 31})
    assert x.shape[1] == 134
    inner = np.array([sum((own["table"][b] for b in [*w, *s]), np.zeros(quality.HIDDEN)) / max(1, len(w)) + p @ own["counts"] + own["bias"] for w, s, p in cut])
    plain = 1 / (1 + np.exp(-(np.tanh(inner) @ own["last"] + own["offset"]) / own["temperature"]))
    assert np.allclose(quality.predict(model, *offsets(texts)), plain, atol=0.02)
    assert plain[:30].min() > plain[30:60].max()


def test_null_ids_are_not_held_out(spark, tmp_path):
    docs = documents(spark, ["some words of a text", "other words", "more words"], [1, None, 4])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1), (4, 0)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for query in (op2_language_id, op10_quality):
        assert {r.doc_id: r.held_out for r in query(spark, str(tmp_path)).collect()}[None] is False
