"""Token-ID output in word-aligned Simple-8b coding.

A page holds the ids of whole documents.  Its ids are coded in blocks of 1,024;
each 64-bit word has a 4-bit selector and as many ids of the selector's width as
fit.  A block starts at a word, and the page lists where, so blocks are decoded
independently and all words of one selector at once.  Ids of 60 bits and more
leave a marked word and stand in a list of escapes.

``write_ids`` range-partitions documents by id, sorts them and writes pages, one
shard per partition, to the shared folder; ``read_ids`` reads the pages back.

Defined cases: null text is the empty text; every document has the end id at
least; strings of the file's added tokens become their ids, as by the library's
defaults; null doc_id comes first; rows of one doc_id come in the table's order
and each is a document; other columns are not read.  The input should be a scan or
a materialised table, whose order is the same when read again.  Memory follows a
page (about 256,000 ids) or the longest text.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm._pretokens import added_tokens, cut_added, library_words, shared_encoder, split_texts
from siltstone.llm._runtime import materialize, ship_package, shuffle_partitions, utf8_slices

#: Fixed values of the format: ids a word and bits an id, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 1024
ESCAPE = np.uint64((1 << 60) - 1)
MAGIC = b"S8B1"
PAGE_IDS = 262_144
SLICE_BYTES = 5_000_000


def _bit_lengths(v: np.ndarray) -> np.ndarray:
    if v.max(initial=0) < 1 << 16:
        return _SMALL.take(v.astype(np.uint16))
    high = (v >> np.uint64(32)).astype(np.float64)
    low = (v & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1]).astype(np.uint8)


#: Bit lengths of the integers below 2**16.
_SMALL = np.frexp(np.arange(1 << 16, dtype=float))[1].astype(np.uint8)


def encode_page(ids: np.ndarray) -> bytes:
    """The page form of unsigned ids."""
    ids = np.asarray(ids).astype(np.uint64)
    n = len(ids)
    rows = -(-n // BLOCK)
    escaped = np.flatnonzero(ids >= ESCAPE)
    wide = BLOCK + int(COUNTS[0])
    grid = np.zeros((rows, wide), np.uint64)
    padded = np.zeros(rows * BLOCK, np.uint64)
    padded[:n] = np.minimum(ids, ESCAPE)
    grid[:, :BLOCK] = padded.reshape(rows, BLOCK)
    # Width of the widest of the next c ids, for each selector's c, by doubling.
    widest, span = _bit_lengths(grid), 1
    pick = np.full((rows, BLOCK), 15, np.uint8)
    for s in range(14, -1, -1):
        c = int(COUNTS[s])
        while span * 2 <= c:
            widest = np.maximum(widest[:, :-span], widest[:, span:])
            span *= 2
        over = np.maximum(widest[:, :BLOCK], widest[:, c - span : c - span + BLOCK])
        pick[over <= WIDTHS[s]] = s
    # All blocks step from word to word together.
    size = np.minimum(BLOCK, n - BLOCK * np.arange(rows))
    at, alive = np.zeros(rows, np.int64), np.arange(rows)
    steps = []
    while len(alive):
        s = pick[alive, at[alive]]
        steps.append((alive, at[alive], s))
        at[alive] += COUNTS[s]
        alive = alive[at[alive] < size[alive]]
    row, start, sel = (np.concatenate(x) for x in zip(*steps)) if steps else (np.zeros(0, np.int64),) * 3
    flat = grid.ravel()
    first = row * wide + start
    order = np.argsort(first)
    first, sel = first[order], sel[order].astype(np.int64)
    words = sel.astype(np.uint64) << np.uint64(60)
    by = np.argsort(sel.astype(np.uint8), kind="stable")
    ends = np.searchsorted(sel[by], np.arange(17))
    for s in range(2, 16):
        if len(m := by[ends[s] : ends[s + 1]]):
            at = first[m]
            packed = words[m]
            for k in range(COUNTS[s]):
                packed |= flat.take(at + k) << np.uint64(k * WIDTHS[s])
            words[m] = packed
    offsets = np.zeros(rows + 1, "<u4")
    np.cumsum(np.bincount(row, minlength=rows), out=offsets[1:])
    head = MAGIC + struct.pack("<IQII", BLOCK, n, len(words), len(escaped))
    return head + offsets.tobytes() + words.astype("<u8").tobytes() + escaped.astype("<u8").tobytes() + ids[escaped].astype("<u8").tobytes()


def decode_page(data: bytes, blocks: range | None = None) -> np.ndarray:
    """Ids of a page, or of a range of its blocks."""
    if data[:4] != MAGIC:
        raise ValueError("not a page of token ids")
    block, n, n_words, n_escapes = struct.unpack_from("<IQII", data, 4)
    rows = -(-n // block)
    at = 24
    offsets = np.frombuffer(data, "<u4", rows + 1, at).astype(np.int64)
    at += 4 * (rows + 1)
    words = np.frombuffer(data, "<u8", n_words, at)
    at += 8 * n_words
    lo, hi = (blocks.start, min(blocks.stop, rows)) if blocks is not None else (0, rows)
    first, end = lo * block, min(n, hi * block)
    words, offsets = words[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
    sel = (words >> np.uint64(60)).astype(np.int64)
    run = np.cumsum(COUNTS[sel]) - COUNTS[sel]
    per = np.diff(offsets)
    row = np.repeat(np.arange(hi - lo), per)
    start = run - (run[offsets[:-1]] if len(run) else run)[row] + row * block if len(run) else run
    limit = np.minimum((row + 1) * block, end - first)
    out = np.zeros(max(0, end - first), np.uint64)
    for s in range(2, 16):
        m = np.flatnonzero(sel == s)
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for k in range(COUNTS[s]) if len(m) else ():
            m = m[start[m] + k < limit[m]]
            out[start[m] + k] = words[m] >> np.uint64(k * WIDTHS[s]) & mask
    if n_escapes:
        where = np.frombuffer(data, "<u8", n_escapes, at).astype(np.int64)
        values = np.frombuffer(data, "<u8", n_escapes, at + 8 * n_escapes)
        m = (where >= first) & (where < end)
        out[where[m] - first] = values[m]
    return out


def tokenized(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc ids, ids, offsets with the end) of runs of whole texts, each text's ids with the end id."""
    encoder = shared_encoder(library_words, path)
    added = added_tokens(path)
    for batch in batches:
        for lo, hi, data, offs in utf8_slices(batch.column(1), SLICE_BYTES):
            data, offs, after, last = cut_added(data, offs, added, end_id)
            tokens, firsts = split_texts(data, offs, "tokenizers")
            flat, at = encoder.encode_tokens(tokens)
            cuts = at[firsts]
            ends = cuts[1:][last] + last + 1
            ids = np.insert(flat, cuts[1:], after)
            yield batch.column(0).slice(lo, hi - lo).to_pylist(), ids, np.concatenate(([0], ends))


_PAGE = pa.schema([("shard", pa.int32()), ("page", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])


def _pages(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, page = TaskContext.get().partitionId(), 0
        docs, lengths, parts, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            row = ([shard], [page], [len(ids)], [docs], [np.concatenate(lengths)], [encode_page(ids)])
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, _PAGE)], schema=_PAGE)

        for own, ids, offs in tokenized(batches, path, end_id):
            docs += own
            lengths.append(np.diff(offs))
            parts.append(ids)
            held += len(ids)
            if held >= PAGE_IDS:
                yield close()
                page += 1
                docs, lengths, parts, held = [], [], [], 0
        if docs:
            yield close()

    return run


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written pages, shards in ascending order of document id."""
    spark = docs.sparkSession
    ship_package(spark)
    source = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    # The place splits the rows of one id, or of none, over partitions.
    order = [F.col("doc_id").asc_nulls_first(), F.col("place")]
    placed = source.withColumn("place", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).drop("place")
    schema = "shard int, page int, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, payload binary"
    return materialize(ordered.mapInArrow(_pages(tokenizer_path, end_id), schema), "token-ids")


def read_ids(pages: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document from the written pages.

    ``start`` needs the totals of earlier shards and pages only: a running sum
    within each shard, and one over the shards, whose number is the partitions'.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, page, docs, lengths, payload = (batch.column(k)[i].as_py() for k in range(5))
                ids = decode_page(payload).astype("<u4")
                ends = np.cumsum(lengths)
                data = memoryview(ids.tobytes())
                crcs = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(docs), pa.int32()), pa.array([page] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(ends - lengths), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                    ["shard", "page", "doc_id", "inner", "n_tokens", "ids_crc32"],
                )

    read = pages.select("shard", "page", "doc_ids", "lengths", "payload").mapInArrow(run, "shard int, page int, doc_id bigint, inner bigint, n_tokens bigint, ids_crc32 bigint")
    sizes = pages.select("shard", "page", "n_ids")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    earlier = Window.partitionBy("shard").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(shards, "shard").select("shard", "page", (F.col("shard_start") + F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))).alias("base"))
    return read.join(starts, ["shard", "page"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
