"""Near-duplicate grouping against all pairs of full sets."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from helpers import TEXTS, documents

from siltstone.llm import near_dup
from siltstone.llm._hashing import shingle_sets, word_hashes

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent):
    """(set sizes, least reachable id) of (id, text) rows, by union-find over all pairs."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [len(s) for _, s in sets], {i: root(i) for i in parent}


def offsets(texts):
    data = [(t or "").encode() for t in texts]
    return b"".join(data), np.concatenate(([0], np.cumsum([len(x) for x in data])))


@pytest.mark.parametrize("width", [1, 4, 5])
def test_shingle_sets(width):
    texts = [*TEXTS, "a b c d e f a b c d e f a b c d e f", "a b", "A B", "a  b\n"]
    found, at = shingle_sets(*offsets(texts), width)
    assert np.diff(at).tolist() == [len(shingles(t, width)) for t in texts]
    sets = [frozenset(found[a:b].tolist()) for a, b in zip(at, at[1:])]
    plain = [frozenset(shingles(t, width)) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            assert (sets[i] == sets[j]) == (plain[i] == plain[j])


def test_long_texts_hash_in_segments(monkeypatch):
    from siltstone.llm import _hashing

    data, offs = offsets(TEXTS)
    whole = word_hashes(data, offs)[0]
    monkeypatch.setattr(_hashing, "SEGMENT", 100)
    assert (word_hashes(data, offs)[0] == whole).all()


@pytest.mark.parametrize("size", [1, 8, 60, 700])
def test_superminhash_estimates_the_similarity(size):
    rng = np.random.default_rng(size)
    errors = []
    for _ in range(40):
        pool = rng.integers(0, 2**63, size + size // 4, dtype=np.uint64)
        a, b = np.sort(pool[:size]), np.sort(pool[size // 4 :])
        signed = near_dup.superminhash(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
        assert (signed >> np.uint64(32)).max() < near_dup.SLOTS
        errors.append((signed[0] == signed[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def test_superminhash_is_a_function_of_the_set():
    rng = np.random.default_rng(0)
    sets = [np.sort(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (3, 2000, 40)]
    together = near_dup.superminhash(np.concatenate(sets), np.array([0, 3, 2003, 2043]))
    for s, row in zip(sets, together):
        assert (near_dup.superminhash(s, np.array([0, len(s)]))[0] == row).all()


def test_screen_never_loses_a_link():
    rng = np.random.default_rng(4)
    screen = near_dup.Screen(80)
    for size in (5, 50, 400, 6000):
        for _ in range(30):
            extra = int(rng.integers(0, size // 4 + 1))
            pool = rng.integers(0, 2**63, size + extra, dtype=np.uint64)
            sets = [np.sort(pool[:size]), np.sort(pool[extra:])]
            at = np.array([0, size, 2 * size])
            both = np.concatenate(sets)
            x, y = np.hstack((near_dup.sketch_bytes(near_dup.superminhash(both, at)), near_dup.parity_bytes(both, at)))
            common = len(np.intersect1d(*sets))
            if 100 * common >= 80 * (2 * size - common):
                assert screen(x, size, y, size)


def corpus(seed):
    """Families of copies at all distances, whose members are not all linked with each other."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for family in range(12):
        base = rng.choices(words, k=rng.choice((3, 6, 30, 80, 200)))
        for _ in range(rng.choice((1, 2, 12))):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 12) + 1)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
            if rng.random() < 0.4:
                base = copy
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "width"), [(1, 4), (2, 5)])
def test_groups_are_brute_force(spark, seed, width):
    texts = [*TEXTS, *corpus(seed)]
    ids = random.Random(seed).sample(range(1000), len(texts))
    rows = near_dup.near_duplicates(documents(spark, texts, ids).repartition(3), width, 80).collect()
    sizes, roots = brute(list(zip(ids, texts)), width, 80)
    assert {r.doc_id: r.n_shingles for r in rows} == dict(zip(ids, sizes))
    assert {r.doc_id: r.component_id for r in rows} == roots
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_leftover_pairs_find_what_the_leader_misses(spark):
    """A bucket's leader that is like nobody hides no link among the others."""
    sets = {1: range(0, 100), 2: range(500, 600), 3: range(505, 605), 4: range(900, 1000)}
    rows = []
    for doc, values in sets.items():
        own = np.sort(np.random.default_rng(7).permutation(2**20)[: 10**4].astype(np.uint64)[list(values)])
        at = np.array([0, len(own)])
        rows.append((doc, 100, bytearray(np.hstack((near_dup.sketch_bytes(near_dup.superminhash(own, at)), near_dup.parity_bytes(own, at)))[0].tobytes())))
    sketches = spark.createDataFrame(rows, "doc_id bigint, n_shingles bigint, sketch binary")
    buckets = spark.createDataFrame([(9, d, 1, 4) for d in sets], "key bigint, doc_id bigint, leader bigint, size bigint")
    found = spark.createDataFrame([], "doc_id bigint, component bigint")
    pairs = near_dup.leftover_pairs(buckets, found, sketches, near_dup.Screen(80)).collect()
    assert [(r.a, r.b) for r in pairs] == [(2, 3)]


def test_components(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(6, 90)] + [(k, k - rng.randrange(1, 9)) for k in range(200, 260, 3)]
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    rng.shuffle(links)
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(5)
    got = {r.doc_id: r.component for r in near_dup.components(df).collect()}
    assert got == {x: root(x) for x in list(parent) if root(x) != x}


def test_null_repeated_and_no_ids(spark):
    text = "one two three four five six"
    docs = documents(spark, [text, text, text, None, "alone"], [3, 3, None, None, 9])
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(3, 3, True), (3, 3, True), (None, None, True), (None, None, True), (9, 9, True)], key=str)
    left = near_dup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == sorted([("3", text), ("None", "None"), ("9", "alone")])
    empty = documents(spark, []).limit(0)
    assert near_dup.near_duplicates(empty).isEmpty() and near_dup.drop_near_duplicates(empty).isEmpty()


def test_only_linked_rows_go(spark):
    """Rows of one id with different texts all stay, and helper columns overwrite none of the table's."""
    rows = [(1, "one two three four five six", 9), (1, "a totally different text of words", 8), (2, "one two three four five SIX", 7), (None, "lone row of no id at all", 6)]
    docs = spark.createDataFrame([(i, t, *[x] * 7) for i, t, x in rows], "doc_id bigint, text string, row int, Maybe int, chunk int, marks int, __place__ int, `a.b` int, salt int")
    left = near_dup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(tuple(r)[1:] for r in left.collect()) == sorted((t, *[x] * 7) for i, t, x in rows if i != 2)


def test_rows_of_one_id_and_text(spark):
    docs = documents(spark, ["x y z", "x  y Z", "x y z", "other"], [4, 4, 4, 4])
    kept = [r.text for r in near_dup.drop_near_duplicates(docs).collect()]
    assert len(kept) == 2 and "other" in kept


def test_components_by_stars(spark, monkeypatch):
    """The rounds between tasks, with a hub, come to the same as one task."""
    monkeypatch.setattr(near_dup, "FEW_LINKS", 3)
    monkeypatch.setattr(near_dup, "HOT", 10)
    test_components(spark)


def test_groups_with_salted_keys(spark, monkeypatch):
    """Every join that salts hot keys, on keys that are hot from three rows on."""
    monkeypatch.setattr(near_dup, "HOT", 2)
    monkeypatch.setattr(near_dup, "SALT", 4)
    monkeypatch.setattr(near_dup, "CHUNK", 2)
    base = [f"w{i}" for i in range(60)]
    copies = []
    for k in range(25):
        copy = list(base)
        copy[k] = "x"
        copies.append(" ".join(copy))
    texts = [*copies, *["same words in every one of them"] * 9, *corpus(5)]
    ids = random.Random(5).sample(range(1000), len(texts))
    rows = near_dup.near_duplicates(documents(spark, texts, ids).repartition(3), 4, 80).collect()
    sizes, roots = brute(list(zip(ids, texts)), 4, 80)
    assert {r.doc_id: r.n_shingles for r in rows} == dict(zip(ids, sizes))
    assert {r.doc_id: r.component_id for r in rows} == roots


def test_bitmaps_and_salted_joins(spark):
    from pyspark.sql import functions as F

    from siltstone.llm import _skew

    rows = spark.range(3000).select(F.col("id"), (F.col("id") % 7).alias("k"))
    wanted = rows.where("id % 3 = 0")
    for count in (10, 1000, 10**9):
        found = {r.id for r in _skew.only_keys(rows, ["id"], wanted.select("id"), count).collect()}
        assert found >= set(range(0, 3000, 3))
        assert len(found) < 1200 if count > 10 else True
    assert _skew.only_keys(rows, ["id"], wanted.where("false").select("id"), 0).isEmpty()
    names = spark.createDataFrame([(k, f"n{k}") for k in (0, 1, 2, 5)], "k bigint, name string")
    hot = spark.createDataFrame([(1,), (2,)], "k bigint")
    for how in ("inner", "left"):
        spread = sorted(tuple(r) for r in _skew.spread_join(rows, names, ["k"], hot, how).select("id", "k", F.coalesce("name", F.lit(""))).collect())
        assert spread == sorted(tuple(r) for r in rows.join(names, "k", how).select("id", "k", F.coalesce("name", F.lit(""))).collect())
