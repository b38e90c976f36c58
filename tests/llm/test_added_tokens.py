"""Added tokens of the tokenizer files against the library at its defaults."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import TEXTS, documents

import corpus_pipeline
from siltstone.llm import packing, queries, token_store

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
AWKWARD = ["<|endoftext|>", "a<|endoftext|>b", "<|endoftext|><|endoftext|> <|startoftext|>ΑΣ<|endoftext|> x", "<|endoftext", "|>", "<|ENDOFTEXT|>", "  <|endoftext|>  é", *[t for t in TEXTS if t]]


def library(path):
    import tokenizers

    own = tokenizers.Tokenizer.from_file(path)
    return lambda text, end: own.encode(text, add_special_tokens=False).ids + [end]


def test_store(spark):
    rows = token_store.read_ids(token_store.write_ids(documents(spark, AWKWARD).repartition(2), BYTES)).collect()
    encode = library(BYTES)
    expected = {i: zlib.crc32(np.array(encode(t, 0), "<u4").tobytes()) for i, t in enumerate(AWKWARD)}
    assert {r.doc_id: r.ids_crc32 for r in rows} == expected
    starts = [(r.start, r.n_tokens) for r in sorted(rows, key=lambda r: r.start)]
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_packing():
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(AWKWARD))), pa.array(AWKWARD)], ["doc_id", "text"])
    encode = library(WORDS)
    assert [(i, ids.tolist()) for i, ids in packing.tokenized(iter([batch]), WORDS, 2)] == [(i, encode(t, 2)) for i, t in enumerate(AWKWARD)]


@pytest.mark.parametrize("name", ["op4_token_store", "op6_packing", "pipeline"])
def test_queries_give_added_ids(spark, tmp_path, name):
    documents(spark, ["a <|endoftext|> b"]).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    row = (corpus_pipeline.sequence_packing(spark, docs, str(tmp_path)) if name == "pipeline" else queries.QUERIES[name](spark, str(tmp_path))).first()
    path, end = (BYTES, 0) if name == "op4_token_store" else (WORDS, 2)
    assert (row["n_tokens" if name == "op4_token_store" else "doc_tokens"]) == len(library(path)("a <|endoftext|> b", end))
