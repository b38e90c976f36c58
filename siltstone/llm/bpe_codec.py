"""Byte-level BPE encoding and decoding through a global distinct-word shuffle.

1. Texts are cut into pre-tokens; every block of documents sends each of its
   distinct words, with the word's positions in the block, to the word's bucket.
2. A bucket encodes each distinct word once and sends its ids and positions back
   to the block.  A word that fills much of a block (over 1/64 of its tokens) is
   salted over the buckets by a hash of word and block, so no bucket gathers a hot
   word's positions; the blocks' directories are dealt by a hash of the block.
3. A block puts the ids in order of position and cuts them at its documents.

Rows travel as one compressed value per (block, bucket), not one per token: the
shuffles move about one byte a token.  Decoding joins ids with the table of token
bytes by position, a table fixed by the vocabulary.

Defined cases: null text is the empty text with no ids; null and repeated doc_id
are kept as they are, a row for each input row; other columns are not read.  A
block holds whole documents, so memory follows the block size (14 MB of text) or
the longest text.  Block numbers derive from the partition, so the input should be
a scan or a materialised table whose partitions are the same when read again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._pretokens import WordEncoder, rank_words, read_ranks, split_texts
from siltstone.llm._runtime import binary_column, ragged_take, ship_package, shuffle_partitions, utf8_slices, varint_decode, varint_encode

BLOCK_BYTES = 14_000_000
SLICE_BYTES = 2_000_000
HOT_SHARE = 64
#: Words that a bucket remembers for certain; above it the least recently used are encoded anew.
REMEMBERED = 1_000_000


def _pack(*parts: bytes | np.ndarray) -> bytes:
    import zstandard

    raw = [p if isinstance(p, bytes) else p.tobytes() for p in parts]
    head = np.array([len(parts), *map(len, raw)], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(raw))


def _unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = int(raw[:4].view("<u4")[0])
    cuts = np.cumsum([4 + 4 * n, *raw[4 : 4 + 4 * n].view("<u4").tolist()])
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def salted(word: int, block: int, buckets: int) -> int:
    """The bucket of a word (by its checksum) in one block."""
    return zlib.crc32(block.to_bytes(8, "little"), word) % buckets


def _varints(values: np.ndarray) -> np.ndarray:
    return varint_encode(values)[0]


def _block_rows(block: int, docs: list, counts: np.ndarray, tokens: pa.ChunkedArray, buckets: int) -> Iterator[tuple[int, int, bool, bytes]]:
    """(bucket, block, is directory, payload) of one block of documents."""
    ids = np.array([0 if d is None else d for d in docs], "<i8")
    yield salted(0, block, buckets), block, True, _pack(ids, np.array([d is None for d in docs], np.uint8), _varints(counts))
    if not len(tokens):
        return
    coded = tokens.combine_chunks().dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    words = coded.dictionary.to_pylist()
    times = np.bincount(index, minlength=len(words))
    checks = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    bucket = checks % buckets
    for i in np.flatnonzero(times * HOT_SHARE > len(index)).tolist():
        bucket[i] = salted(int(checks[i]), block, buckets)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(words), np.uint64)
    rank[order] = np.arange(len(words), dtype=np.uint64)
    keyed = rank[index] << np.uint64(32) | np.arange(len(index), dtype=np.uint64)
    keyed.sort()
    positions = (keyed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    del keyed
    times = times[order]
    ends = np.cumsum(times)
    where, firsts = np.unique(bucket[order], return_index=True)
    # Words of a bucket stand in order of their first places, so these are small steps too.
    deltas = np.diff(positions, prepend=0)
    deltas[ends - times] = np.diff(positions[ends - times], prepend=0)
    deltas[(ends - times)[firsts]] = positions[(ends - times)[firsts]]
    packed, at = varint_encode(deltas)
    for b, lo, hi in zip(where.tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(words)]):
        own = [words[i] for i in order[lo:hi].tolist()]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        yield b, block, False, _pack(_varints(sizes), b"".join(own), _varints(times[lo:hi]), packed[at[ends[lo] - times[lo]] : at[ends[hi - 1]]])


_ROUTED = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("directory", pa.bool_()), ("payload", pa.binary())])


def _routed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROUTED)], schema=_ROUTED)


def _split(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            held, docs, size = [], [], 0
            ids = batch.column(0).to_pylist()
            for lo, hi, data, offs in utf8_slices(batch.column(1), SLICE_BYTES):
                tokens, firsts = split_texts(data, offs, "tiktoken")
                held.append((tokens, np.diff(firsts)))
                docs += ids[lo:hi]
                size += len(data)
                if size >= BLOCK_BYTES or hi == len(ids):
                    yield _routed(list(_block_rows(block, docs, np.concatenate([c for _, c in held]), pa.chunked_array([t for t, _ in held]), buckets)))
                    block, held, docs, size = block + 1, [], [], 0

    return run


def _encode(ranks_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(rank_words(ranks_path), REMEMBERED // 2)
        for batch in batches:
            for row in batch.to_pylist():
                if not row["directory"]:
                    sizes, data, times, positions = _unpack(row["payload"])
                    cuts = np.concatenate(([0], np.cumsum(varint_decode(sizes))))
                    flat, offs = encoder.encode(binary_column(data.tobytes(), cuts).to_pylist())
                    narrow = "<u2" if flat.max(initial=0) < 1 << 16 else "<u4"
                    row["payload"] = _pack(_varints(np.diff(offs)), flat.astype(narrow), times, positions)
                yield _routed([(row["bucket"], row["block"], row["directory"], row["payload"])])

    return run


def _assemble(rows: Iterator[dict]) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc ids, ids of the whole block, offset of each document's ids with the end); the directory comes first."""
    ids, missing, counts = _unpack(next(rows)["payload"])
    docs = [None if m else i for i, m in zip(ids.view("<i8").tolist(), missing.tolist())]
    counts = varint_decode(counts)
    word_of = np.zeros(int(counts.sum()), np.int32)
    flats, lengths, base = [], [], 0
    for row in rows:
        sizes, flat, times, deltas = _unpack(row["payload"])
        sizes, times, deltas = map(varint_decode, (sizes, times, deltas))
        flat = flat.view("<u2" if len(flat) == 2 * sizes.sum() else "<u4")
        first = np.cumsum(times) - times
        steps = deltas.copy()
        steps[first] = 0
        run = np.cumsum(steps)
        positions = run - np.repeat(run[first] - np.cumsum(deltas[first]), times)
        word_of[positions] = np.repeat(np.arange(base, base + len(times)), times)
        base += len(times)
        flats.append(flat.astype("<u4"))
        lengths.append(sizes)
    if not flats:
        return docs, np.zeros(0, "<u4"), np.zeros(len(docs) + 1, np.int64)
    offs = np.concatenate(([0], np.cumsum(np.concatenate(lengths))))
    out, at = ragged_take(np.concatenate(flats), offs, word_of)
    return docs, out, at[np.concatenate(([0], np.cumsum(counts)))]


def _join_back(finish):
    """Blocks reassembled from their rows; ``finish(docs, ids, offsets)`` makes their batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for i in range(0, batch.num_rows, 64) for row in batch.slice(i, 64).to_pylist())
        for _, own in groupby(rows, key=lambda r: r["block"]):
            yield from finish(*_assemble(own))

    return run


def _coded(docs: DataFrame, ranks_path: str, id_col: str, text_col: str, finish, schema: str) -> DataFrame:
    spark = docs.sparkSession
    ship_package(spark)
    buckets = shuffle_partitions(spark)
    source = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    routed = "bucket bigint, block bigint, directory boolean, payload binary"
    words = source.mapInArrow(_split(buckets), routed).repartition(buckets, "bucket")
    coded = words.mapInArrow(_encode(ranks_path), routed).repartition(buckets, "block").sortWithinPartitions("block", F.desc("directory"))
    return coded.mapInArrow(_join_back(finish), schema)


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) of every whole text; ids as little-endian unsigned 32-bit integers."""

    def finish(own: list, ids: np.ndarray, offs: np.ndarray) -> Iterator[pa.RecordBatch]:
        column = binary_column(ids.tobytes(), offs * 4).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(np.diff(offs)), column], ["doc_id", "n_tokens", "ids"])

    return _coded(docs, ranks_path, id_col, text_col, finish, "doc_id bigint, n_tokens bigint, ids binary")


def encode_and_decode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded, decoded again and digested block by block.

    What ``digest_documents`` makes of ``encode_documents``, without handing the ids
    from one Python worker to the next.
    """

    def finish(own: list, ids: np.ndarray, offs: np.ndarray) -> Iterator[pa.RecordBatch]:
        lo = 0
        while lo < len(own):
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + 1_000_000, side="right")) - 1)
            text, decoded = _digests(ids[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], ranks_path)
            yield pa.RecordBatch.from_arrays([pa.array(own[lo:hi], pa.int64()), pa.array(np.diff(offs[lo : hi + 1])), text, decoded], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            lo = hi

    return _coded(docs, ranks_path, id_col, text_col, finish, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


@lru_cache(maxsize=2)
def token_bytes(ranks_path: str) -> pa.Array:
    """The token-byte table: bytes of each id, empty where an id is free."""
    ranks = read_ranks(ranks_path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return pa.array(table, pa.large_binary())


@lru_cache(maxsize=2)
def _decimals(n: int) -> pa.Array:
    return pa.array([b"%d," % i for i in range(n)], pa.large_binary())


def _joined(table: pa.Array, ids: np.ndarray, offs: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """Values of ids end to end, and the byte offset of each document's."""
    taken = table.take(pa.array(ids))
    _, at, data = taken.buffers()
    at = np.frombuffer(at, np.int64)[taken.offset : taken.offset + len(taken) + 1]
    return memoryview(data) if data is not None else memoryview(b""), at[offs]


def _id_slices(batch: pa.RecordBatch, place: int, limit: int = 4_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, data, offs in utf8_slices(batch.column(place), limit):
        yield lo, hi, np.frombuffer(data, "<u4"), offs // 4


def decode_documents(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded): the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(ranks_path)
        for batch in batches:
            for lo, hi, ids, offs in _id_slices(batch, 1):
                data, at = _joined(table, ids, offs)
                decoded = [bytes(data[a:b]) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(decoded, pa.binary())], ["doc_id", "decoded"])

    ship_package(encoded.sparkSession)
    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id bigint, decoded binary")


def _digests(ids: np.ndarray, offs: np.ndarray, ranks_path: str) -> tuple[pa.Array, pa.Array]:
    """Digests of each document's ids as decimal text, and of its decoded bytes."""
    table = token_bytes(ranks_path)
    sha = lambda data, at, less: pa.array([hashlib.sha256(data[a : max(a, b - less)]).hexdigest() for a, b in zip(at, at[1:])], pa.string())
    return sha(*_joined(_decimals(len(table)), ids, offs), 1), sha(*_joined(table, ids, offs), 0)


def digest_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Digests of the ids as decimal text and of the decoded bytes, per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, ids, offs in _id_slices(batch, 2):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *_digests(ids, offs, ranks_path)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    ship_package(encoded.sparkSession)
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
