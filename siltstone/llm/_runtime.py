"""Session plumbing that the training-data operators share.

Cut lineage goes to Parquet tables below ``spark.checkpoint.dir`` (one folder
that every executor sees), so a lost executor costs a re-read and never a
recomputation that could differ.  Without that setting a local session writes to a
folder of its own and any other is refused.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers of other machines."""
    sc = spark.sparkContext
    if _is_local(spark) and (str(ROOT) in map(os.path.abspath, os.environ.get("PYTHONPATH", "").split(os.pathsep)) or Path.cwd() == ROOT) or sc.applicationId in _shipped:
        return
    # The archive is served by the driver to every executor.
    archive = Path(tempfile.mkdtemp(prefix="siltstone")) / "siltstone.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((ROOT / "siltstone").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut lineage: the session's own, else a new local one in a local session."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not found and not _is_local(spark):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        found = getattr(shared_dir, "local", None) or tempfile.mkdtemp(prefix="siltstone-shared")
        shared_dir.local = found
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siltstone/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(columns: list[str], name: str) -> str:
    """A column name that none of ``columns`` has, in either case."""
    taken = {c.lower() for c in columns}
    return next(x for x in (name, *(f"{name}_{i}" for i in range(len(columns) + 1))) if x not in taken)


def named(columns: list[str]) -> list:
    """Columns by names that may hold dots."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def crc32_bucket(column, modulus: int):
    """crc32 of the id's decimal text modulo a number, as the held-out splits are defined; null ids have none."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


# ---------------------------------------------------------------- Arrow batches


def utf8_slices(column: pa.Array, limit: int, rows: int = 8192) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Whole texts of a string column in runs of about ``limit`` bytes and ``rows`` texts at most.

    Yields (first row, end row, UTF-8 bytes, byte offsets of the rows and the
    end).  Null counts as empty.  A text over the limit is a run of its own, so
    memory follows the longest text, not the batch.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = memoryview(data) if data is not None else memoryview(b"")
    at = 0
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
        end = min(n, max(at + 1, end), at + rows)
        yield at, end, bytes(raw[offs[at] : offs[end]]), offs[at : end + 1] - offs[at]
        at = end


def binary_column(data, offsets: np.ndarray) -> pa.Array:
    """A large binary Arrow column over ``data`` cut at ``offsets``."""
    offsets = np.ascontiguousarray(offsets, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def kept_rows(docs, text_col: str, decide):
    """Rows of ``docs``, all columns as they are, for which ``decide(bytes, offsets)`` holds.

    ``decide`` is made once a task by calling the given factory, and gets whole texts.
    """
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds = decide()
        for batch in batches:
            for lo, hi, data, offs in utf8_slices(batch.column(place), 1_000_000):
                yield batch.slice(lo, hi - lo).filter(pa.array(np.asarray(holds(data, offs), bool)))

    ship_package(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def ragged_take(flat: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``index`` of a ragged array, end to end, and their offsets."""
    lengths = (offsets[1:] - offsets[:-1])[index]
    out = np.zeros(len(index) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    kind = np.int32 if max(out[-1], len(flat)) < 1 << 31 else np.int64
    where = np.arange(out[-1], dtype=kind)
    where += np.repeat((offsets[:-1][index] - out[:-1]).astype(kind), lengths)
    return flat.take(where), out


def varint_encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LEB128 bytes of unsigned values, and each value's offset (with the end)."""
    kind = np.uint32 if len(values) == 0 or values.max() < 1 << 32 else np.uint64
    v = values.astype(kind)
    size = np.ones(len(v), np.uint8)
    for bits in range(7, 64 if kind is np.uint64 else 32, 7):
        over = v >= kind(1 << bits)
        if not over.any():
            break
        size += over
    offs = np.zeros(len(v) + 1, np.int64)
    np.cumsum(size, out=offs[1:])
    out = np.zeros(offs[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        m = np.flatnonzero(size > k) if k else slice(0, len(v))
        out[offs[:-1][m] + k] = ((v[m] >> kind(7 * k)) & kind(127)).astype(np.uint8) | ((size[m] > k + 1).astype(np.uint8) << np.uint8(7))
    return out, offs


def varint_decode(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate(([0], ends[:-1] + 1))
    shift = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * shift), starts)
