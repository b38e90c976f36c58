"""Encoding, token files and packing against the libraries' own results."""

from __future__ import annotations

import hashlib
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from helpers import TEXTS, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import bpe_codec, packing, token_store
from siltstone.llm._pretokens import WordEncoder, rank_words, read_ranks, split_texts
from siltstone.llm._runtime import ragged_take, utf8_slices, varint_decode, varint_encode

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PATTERN = regex.compile(public_tokenizers.PATTERN)


def library(path):
    import tokenizers

    own = tokenizers.Tokenizer.from_file(path)
    return lambda text, end: own.encode(text or "", add_special_tokens=False).ids + [end]


@pytest.fixture(scope="module")
def tiktoken_encode():
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    return lambda text: own.encode_ordinary(text or "")


def split(texts):
    out = []
    for lo, hi, data, offs in utf8_slices(pa.array(texts, pa.string()), 64):
        tokens, firsts = split_texts(data, offs, "tiktoken")
        tokens = tokens.to_pylist()
        out += [[x.decode() for x in tokens[firsts[i] : firsts[i + 1]]] for i in range(hi - lo)]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abst'' redlvm  \n\t'!.19éßΣ　 ́½日😀_")), max_size=20), max_size=5))
def test_pre_tokens_are_the_patterns_matches(texts):
    assert split(texts) == [PATTERN.findall(t) for t in texts]


def test_pre_tokens_of_awkward_texts():
    assert split(TEXTS) == [PATTERN.findall(t or "") for t in TEXTS]


def test_word_encoder_forgets_and_is_right():
    calls = []
    encoder = WordEncoder(lambda words: calls.append(len(words)) or (np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])), most=4)
    words = [b"%d" % (i % 9) for i in range(60)]
    for lo in range(0, 60, 5):
        flat, offs = encoder.encode(words[lo : lo + 5])
        assert [flat[a:b].tolist() for a, b in zip(offs, offs[1:])] == [list(w) for w in words[lo : lo + 5]]
    assert len(encoder.young) + len(encoder.old) <= 20


def test_ragged_take_and_varints():
    flat, offs = np.arange(10), np.array([0, 3, 3, 10])
    taken, at = ragged_take(flat, offs, np.array([2, 1, 0, 0]))
    assert taken.tolist() == [3, 4, 5, 6, 7, 8, 9, 0, 1, 2, 0, 1, 2] and at.tolist() == [0, 7, 7, 10, 13]
    values = np.array([0, 1, 127, 128, 300, 2**31, 2**40])
    assert varint_decode(varint_encode(values)[0]).tolist() == values.tolist()
    assert len(varint_decode(np.zeros(0, np.uint8))) == 0


def test_codec(spark, tiktoken_encode):
    ids = [*range(len(TEXTS) - 2), None, 3]
    docs = documents(spark, TEXTS, ids).repartition(3)
    encoded = bpe_codec.encode_documents(docs, RANKS).cache()
    got = sorted((r.doc_id is None, r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.n_tokens) for r in encoded.collect() if r.doc_id is not None)
    assert got == sorted((False, i, tiktoken_encode(t), len(tiktoken_encode(t))) for i, t in zip(ids, TEXTS) if i is not None)
    assert encoded.count() == len(TEXTS)
    decoded = sorted(bytes(r.decoded) for r in bpe_codec.decode_documents(encoded, RANKS).collect())
    assert decoded == sorted((t or "").encode() for t in TEXTS)
    digests = {(r.ids_sha256, r.decoded_sha256) for r in bpe_codec.digest_documents(encoded, RANKS).collect()}
    at_once = [tuple(r) for r in bpe_codec.encode_and_decode(docs, RANKS).collect()]
    assert sorted(at_once, key=str) == sorted((tuple(r) for r in bpe_codec.digest_documents(encoded, RANKS).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert digests == {(sha(",".join(map(str, tiktoken_encode(t))).encode()), sha((t or "").encode())) for t in TEXTS}


def test_codec_with_a_hot_word(spark, tiktoken_encode):
    texts = ["hot " * 5000 + f"tail{i}" for i in range(8)]
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe_codec.encode_documents(documents(spark, texts).repartition(4), RANKS).collect()}
    assert got == {i: tiktoken_encode(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("buckets", [4, 200, 1024])
def test_hot_words_and_directories_spread_over_buckets(buckets):
    """Blocks that are each the first of its partition."""
    tokens = pa.chunked_array([pa.array([t.encode() for t in split(["hot hot hot hot"])[0]], pa.large_binary())])
    hot, directories = Counter(), Counter()
    for partition in range(3000):
        for bucket, _, is_directory, _ in bpe_codec._block_rows(partition << 32, [1], np.array([4]), tokens, buckets):
            (directories if is_directory else hot)[bucket] += 1
    assert len(directories) == len(hot) == buckets or buckets == 1024 and min(len(directories), len(hot)) > 900
    # Two hot words a block ("hot" and " hot").
    assert max(directories.values()) < 3 * 3000 / buckets + 10 and max(hot.values()) < 3 * 6000 / buckets + 10


def test_very_long_runs(spark):
    """The library's own splitting fails on a million blanks; its encoding of one piece does not."""
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    texts = ["a" + " " * 1_500_000 + "b", "\n" * 1_000_001, "ab" * 300_000, " " * 700_000]
    got = {r.doc_id: r for r in bpe_codec.encode_and_decode(documents(spark, texts), RANKS).collect()}
    for i, text in enumerate(texts):
        ids = [x for piece in PATTERN.findall(text) for x in own._encode_single_piece(piece)]
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def random_texts(n, seed):
    """Texts of characters of all planes, also of Unicode versions that this Python does not know."""
    rng = random.Random(seed)
    common = list("abcAB 's'T'll 12 é\n\t \u0301ΣσςİıẞßÅ가각日ᄀ") + ["<|endoftext|>", "<|startoftext|>", "\u0307", "\u08d1", *map(chr, (0x1C8A, 0xA7CB, 0xA7CE, 0xA7DC, 0x10D65, 0x16EA1, 0x16EB7, 0x105C9, 0x16121))]
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    named = [c for c in points if unicodedata.category(chr(c)) not in ("Cn", "Co")]
    return ["".join(rng.choice(common) if rng.random() < 0.6 else chr(rng.choice(named if rng.random() < 0.8 else points)) for _ in range(rng.randrange(20))) for _ in range(n)]


def test_random_texts_are_encoded_as_by_the_libraries(tiktoken_encode):
    texts = random_texts(20_000, 9)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    encode = library(WORDS)
    assert [(i, ids.tolist()) for i, ids in packing.tokenized(iter([batch]), WORDS, 2)] == [(i, encode(t, 2)) for i, t in enumerate(texts)]
    encode = library(BYTES)
    for docs, ids, offs in token_store.tokenized(iter([batch]), BYTES, 0):
        for k, i in enumerate(docs):
            assert ids[offs[k] : offs[k + 1]].tolist() == encode(texts[i], 0)
    encoder = WordEncoder(rank_words(RANKS))
    for lo, hi, data, offs in utf8_slices(batch.column(1), 50_000):
        tokens, firsts = split_texts(data, offs, "tiktoken")
        flat, at = encoder.encode_tokens(tokens)
        for i in range(lo, hi):
            assert flat[at[firsts[i - lo]] : at[firsts[i - lo + 1]]].tolist() == tiktoken_encode(texts[i])


def test_empty_tables(spark):
    empty = documents(spark, []).limit(0)
    assert bpe_codec.encode_documents(empty, RANKS).isEmpty()
    assert token_store.read_ids(token_store.write_ids(empty, BYTES)).isEmpty()
    assert packing.pack_documents(empty, WORDS).isEmpty()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 62).flatmap(lambda b: st.lists(st.integers(0, 2**b), max_size=3000)))
def test_pages_round_trip(values):
    page = token_store.encode_page(np.array(values, np.uint64))
    assert token_store.decode_page(page).tolist() == values


def test_pages_by_block_and_escapes():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 50_000, 5000).astype(np.uint64)
    values[[7, 1023, 1024, 4999]] = [2**64 - 1, 2**60 - 1, 2**63, 2**60]
    values[2000:2300] = 0
    page = token_store.encode_page(values)
    assert (token_store.decode_page(page) == values).all()
    for b in range(5):
        assert (token_store.decode_page(page, range(b, b + 1)) == values[1024 * b : 1024 * (b + 1)]).all()
    assert len(token_store.encode_page(np.zeros(4096, np.uint64))) < 300
    with pytest.raises(ValueError):
        token_store.decode_page(b"nothing")


def test_store(spark):
    ids = random.Random(3).sample(range(-50, 50), len(TEXTS))
    docs = documents(spark, TEXTS, ids).repartition(3)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_ids(token_store.write_ids(docs, BYTES)).collect()}
    encode, at = library(BYTES), 0
    for i, text in sorted(zip(ids, TEXTS)):
        own = encode(text, 0)
        assert got[i] == (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)


def test_store_keeps_null_and_repeated_ids(spark):
    docs = documents(spark, ["b", "a", "a", None], [5, 5, 5, None])
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_store.read_ids(token_store.write_ids(docs, BYTES)).collect())
    assert got == [(0, None, 1), (1, 5, 2), (3, 5, 2), (5, 5, 2)]


def test_packing(spark):
    docs = documents(spark, TEXTS * 3).repartition(2)
    rows = packing.pack_documents(docs, WORDS).collect()
    encode = library(WORDS)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(3 * len(TEXTS)))
    for i, pieces in by_doc.items():
        ids, at = encode((TEXTS * 3)[i], 2), 0
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


def test_packing_balances_cost():
    rng = random.Random(1)
    lengths = [rng.choice((40, 300, 900, 2500, 9000)) for _ in range(400)]
    pieces, sizes = packing.pack(lengths, 4096)
    assert sum(n for _, _, n, _, _ in pieces) == sum(lengths) == sum(sizes)
    cost = [0.0] * len(sizes)
    for _, _, n, s, _ in pieces:
        cost[s] += n + n * n / 24_576
    full = [c for c, size in zip(cost, sizes) if size == 4096]
    assert len(pieces) < len(lengths) + len(sizes)
    assert max(full) < 1.2 * (sum(full) / len(full))


def test_normal_form_is_the_librarys():
    import tokenizers

    own = tokenizers.Tokenizer.from_file(WORDS).normalizer
    for text in TEXTS[3:12]:
        assert "".join(packing.normal_form(text).split()) == "".join(own.normalize_str(text).split())
