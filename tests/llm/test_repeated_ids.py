"""Rows of one doc_id are one node, also with different texts, but each a document where duplicates go."""

from __future__ import annotations

from helpers import documents

from siltstone.llm import near_dup

A, B, C = ("one two three four five six", "red green blue black white grey", "north east south west up down")


def test_an_id_connects_its_texts(spark):
    rows = [(1, A), (5, A), (5, B), (9, B), (7, C), (8, C), (8, None), (20, "a b"), (20, "c d"), (None, A), (30, None), (12, B), (12, C)]
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()}
    one = {(i, 1, i == 1) for i in (1, 5, 7, 8, 9, 12)}
    assert got == one | {(20, 20, True), (None, None, True), (30, 30, True)}
    left = sorted((str(r.doc_id), str(r.text)) for r in near_dup.drop_near_duplicates(docs).collect())
    # Rows are documents there: one of each text stays, and all without words.
    assert left == sorted([("1", A), ("5", B), ("7", C), ("8", "None"), ("20", "a b"), ("20", "c d"), ("30", "None")])
