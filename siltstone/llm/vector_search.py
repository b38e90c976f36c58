"""Exact top-k inner products by block-at-a-time pruning.

Components x become the integers floor(64 x).  Candidates lie in shards; a shard
orders its vectors by repeated splits at medians, so that ranges of ``BLOCK`` vectors
are alike, and stores a forward index (all components) and each term's largest and
least value for every range.  For a query, the sum over its terms of the larger
product bounds a block's scores.  Blocks are taken in descending order of their
bounds, a few at first and then twice as many, and scored through their forward
index until the next bound is below the query's k-th score.

Queries and shards meet in a grid: queries in groups of about ``QUERY_GROUP`` go to
each column of shards, shards to each group.  A task holds one group and one shard
at a time and keeps k results a query, whose columns are then merged by rank.

Scores are exact: products are summed in the narrowest float type that holds them
exactly, in Python integers beyond 2**53, and kept within 64 bits.

Defined cases: vectors that are null or hold null, NaN or infinite components, and
rows without id, take no part; shorter vectors count as padded with zeros, empty
ones as zero; rows with the query's id are its own and no candidates; repeated
query rows are one query, repeated candidates count each; ties go to the smaller
id; with fewer candidates than k all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm._runtime import materialize, ship_package, shuffle_partitions

SHARD, BLOCK, QUERY_GROUP, QUERY_CHUNK = 8192, 64, 32_768, 1024
FIRST_WAVE = 2
LONG_MAX = (1 << 63) - 1


def quantised(ids: pa.Array, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and integer components (as doubles, padded with zeros) of the valid rows."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = len(vectors)
    valid = np.asarray(vectors.is_valid().to_numpy(zero_copy_only=False)) & np.asarray(ids.is_valid().to_numpy(zero_copy_only=False))
    flat = vectors.flatten()
    lengths = np.asarray(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(n), lengths)
    valid[owner[~np.isfinite(values)]] = False
    first = np.cumsum(lengths) - lengths
    out = np.zeros((n, int(lengths.max(initial=0))))
    # Adding zero makes one zero of both.
    out[owner, np.arange(len(values)) - first[owner]] = np.floor(64 * np.where(np.isfinite(values), values, 0)) + 0.0
    return ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[valid], out[valid]


def _padded(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def similar_order(m: np.ndarray, size: int) -> np.ndarray:
    """Rows so that ranges of ``size`` are alike: splits at the median of the widest dimension."""
    done, todo = [], [np.arange(len(m))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size or m.shape[1] == 0:
            done.append(rows)
            continue
        own = m[rows]
        half = -(-len(rows) // (2 * size)) * size
        order = np.argsort(own[:, int(own.var(axis=0).argmax())], kind="stable")
        todo += [rows[order[half:]], rows[order[:half]]]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


def _narrow(m: np.ndarray) -> np.ndarray:
    top = np.abs(m).max(initial=0)
    return m.astype(np.int16) if top < 1 << 15 else m.astype(np.int32) if top < 1 << 31 else m


def shard_bytes(ids: np.ndarray, m: np.ndarray) -> bytes:
    """A shard: ids, forward index by blocks, and each block's largest and least terms."""
    order = similar_order(m, BLOCK)
    ids, m = ids[order], _narrow(m[order])
    starts = np.arange(0, len(ids), BLOCK)
    ends = (np.maximum.reduceat(m, starts, axis=0), np.minimum.reduceat(m, starts, axis=0)) if m.shape[1] else (np.zeros((len(starts), 0), m.dtype),) * 2
    return struct.pack("<IIc", *m.shape, m.dtype.char.encode()) + ids.tobytes() + m.tobytes() + ends[0].tobytes() + ends[1].tobytes()


def read_shard(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows, width, kind = struct.unpack_from("<IIc", data)
    kind, at, out = np.dtype(kind.decode()), 9, []
    blocks = -(-rows // BLOCK)
    ids = np.frombuffer(data, np.int64, rows, at)
    at += 8 * rows
    for n in (rows, blocks, blocks):
        out.append(np.frombuffer(data, kind, n * width, at).reshape(n, width).astype(np.float64))
        at += n * width * kind.itemsize
    return ids, *out


def _products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact inner products of integers held as doubles; int64, or clipped to it."""
    bound = np.abs(q).max(initial=0) * np.abs(m).max(initial=0) * max(1, q.shape[1])
    if bound < 1 << 24:
        return (q.astype(np.float32) @ m.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (q @ m.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in q], object).reshape(q.shape) @ np.array([[int(x) for x in row] for row in m], object).reshape(m.shape).T
    return np.clip(exact, -LONG_MAX, LONG_MAX).astype(np.int64)


class TopK:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), -LONG_MAX - 1)
        self.ids = np.full((n, k), LONG_MAX)
        self.held = np.zeros(n, np.int64)

    def worst(self) -> np.ndarray:
        """The score that a candidate must reach, by query."""
        return np.where(self.held >= self.k, self.scores[:, -1], -LONG_MAX - 1)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        changed = np.unique(query)
        old = np.flatnonzero(np.arange(self.k)[None, :].repeat(len(changed), 0).ravel() < np.repeat(self.held[changed], self.k))
        q = np.concatenate((query, np.repeat(changed, self.k)[old]))
        s = np.concatenate((score, self.scores[changed].ravel()[old]))
        i = np.concatenate((ids, self.ids[changed].ravel()[old]))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, changed)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        top = rank < self.k
        self.scores[q[top], rank[top]], self.ids[q[top], rank[top]] = s[top], i[top]
        self.held[changed] = np.minimum(self.k, np.diff(np.append(first, len(q))))


def search_shard(query_ids: np.ndarray, q: np.ndarray, shard: tuple, best: TopK, offset: int) -> int:
    """Score a shard's blocks for queries ``offset`` and on; returns how many blocks were scored."""
    ids, m, high, low = shard
    width = max(q.shape[1], m.shape[1])
    q, m, high, low = (_padded(x, width) for x in (q, m, high, low))
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    bounds = plus @ high.T + minus @ low.T
    # Bounds beyond 2**53 are rounded, so they get room.
    bounds += np.abs(bounds) * 1e-9 * (np.abs(bounds) >= 1 << 52)
    order = np.argsort(-bounds, axis=1, kind="stable")
    ranked = np.take_along_axis(bounds, order, axis=1)
    at, wave, scored = 0, FIRST_WAVE, 0
    here = slice(offset, offset + len(q))
    while at < order.shape[1]:
        need = ranked[:, at : at + wave] >= best.worst()[here, None]
        if not need.any():
            break
        rows, which = np.nonzero(need)
        block = order[rows, at + which]
        by = np.argsort(block, kind="stable")
        rows, block = rows[by], block[by]
        found = []
        worst = best.worst()[here]
        for b, lo, hi in zip(*(x.tolist() for x in _runs(block))):
            own = rows[lo:hi]
            part = slice(b * BLOCK, (b + 1) * BLOCK)
            scores = _products(q[own], m[part])
            take, place = np.nonzero((scores >= worst[own][:, None]) & (ids[part][None, :] != query_ids[own][:, None]))
            found.append((own[take] + offset, scores[take, place], ids[part][place]))
            scored += hi - lo
        best.add(*(np.concatenate(x) for x in zip(*found)))
        at, wave = at + wave, wave * 2
    return scored


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values, first = np.unique(sorted_values, return_index=True)
    return values, first, np.append(first[1:], len(sorted_values))


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of a partition's valid vectors."""
    number = TaskContext.get().partitionId() << 32
    held, rows = [], 0

    def close() -> pa.RecordBatch:
        width = max(m.shape[1] for _, m in held)
        data = shard_bytes(np.concatenate([i for i, _ in held]), np.concatenate([_padded(m, width) for _, m in held]))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([data], pa.binary())], ["shard", "payload"])

    for batch in batches:
        for lo in range(0, batch.num_rows, SHARD):
            part = batch.slice(lo, SHARD)
            ids, m = quantised(part.column(0), part.column(1))
            while len(ids):
                room = SHARD - rows
                held.append((ids[:room], m[:room]))
                rows += len(ids[:room])
                ids, m = ids[room:], m[room:]
                if rows >= SHARD:
                    yield close()
                    held, rows, number = [], 0, number + 1
    if rows:
        yield close()


def _queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Query vectors without their last zeros, so that equal ones are equal bytes."""
    for batch in batches:
        ids, m = quantised(batch.column(0), batch.column(1))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([np.trim_zeros(r, "b").tobytes() for r in m], pa.binary())], ["shard", "payload"])


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, rows, q, best = None, [], [], None, None

        def close() -> Iterator[pa.RecordBatch]:
            if best is None:
                return
            for lo in range(0, len(ids), QUERY_CHUNK):
                part = slice(lo, lo + QUERY_CHUNK)
                filled = np.arange(k)[None, :] < best.held[part, None]
                which, rank = np.nonzero(filled)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[part][which]), pa.array([rows[lo + w] for w in which.tolist()], pa.binary()), pa.array(best.ids[part][which, rank]), pa.array(best.scores[part][which, rank])],
                    ["query_id", "vector", "vec_id", "score"],
                )

        for batch in batches:
            for i in range(batch.num_rows):
                now = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if now != key:
                    yield from close()
                    key, ids, rows, q, best = now, [], [], None, None
                number, payload = batch.column(3)[i].as_py(), batch.column(4)[i].as_py()
                if batch.column(2)[i].as_py() == 0:
                    ids.append(number)
                    rows.append(payload)
                    continue
                if not len(ids):
                    continue
                if best is None:
                    width = max(len(r) for r in rows) // 8
                    q = np.zeros((len(rows), width))
                    for j, r in enumerate(rows):
                        q[j, : len(r) // 8] = np.frombuffer(r)
                    ids, best = np.array(ids), TopK(len(rows), k)
                shard = read_shard(payload)
                for lo in range(0, len(ids), QUERY_CHUNK):
                    search_shard(ids[lo : lo + QUERY_CHUNK], q[lo : lo + QUERY_CHUNK], shard, best, lo)
        yield from close()

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row where ``is_query`` holds.

    ``is_query`` is a condition on the column ``vec_id``.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), vectors[vector_col].alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    asked = rows.where(is_query)
    packed = "shard bigint, payload binary"
    shards = materialize(rows.mapInArrow(_build, packed), "vector-shards")
    columns = max(1, min(shuffle_partitions(spark), shards.count()))
    groups = max(1, -(-asked.count() // QUERY_GROUP))
    number = lambda n: F.pmod(F.xxhash64("shard", "payload"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = asked.mapInArrow(_queries, packed).distinct().withColumn("group", number(groups)).select("group", every(columns).alias("column"), F.lit(0).alias("side"), "shard", "payload")
    met = shards.withColumn("column", number(columns)).select(every(groups).alias("group"), "column", F.lit(1).alias("side"), "shard", "payload")
    grid = queries.unionByName(met).repartition(min(shuffle_partitions(spark), groups * columns), "group", "column").sortWithinPartitions("group", "column", "side")
    found = grid.mapInArrow(_search(k), "query_id bigint, vector binary, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id", "vector").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
