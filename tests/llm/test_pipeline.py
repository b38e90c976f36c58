"""The rows of the whole pipeline against a plain encoding of the texts that its stages keep."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers

import corpus_pipeline
from siltstone.llm._runtime import materialize


def test_pieces_are_the_kept_texts(spark, data):
    import tokenizers

    own = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, data), f"plain-{name}")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    by_doc, by_sequence = {}, {}
    for r in corpus_pipeline.run(spark, data).collect():
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts) and len(texts) > 0
    for i, pieces in by_doc.items():
        ids, at = own.encode(texts[i], add_special_tokens=False).ids + [2], 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == pieces[0].sequence_tokens and (at == 4096 or at & (at - 1) == 0)
