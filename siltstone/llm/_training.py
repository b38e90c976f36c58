"""Bounded samples and the last, single task of training, shared by the two classifiers."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._runtime import ship_package


#: Labels that a classifier may tell apart.
MOST_LABELS = 10_000


def sample_by_label(rows: DataFrame, per_label: int) -> tuple[DataFrame, dict]:
    """Rows of (doc_id, label, ...), about ``per_label`` at most of each label, and each label's size.

    A row is chosen by a hash of its id, so the choice depends neither on the order
    nor on the partitions.
    """
    found = rows.groupBy("label").agg(F.count("*").alias("n")).limit(MOST_LABELS + 1).collect()
    if len(found) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    sizes = {r["label"]: r["n"] for r in found}
    if not sizes:
        return rows.where(F.lit(False)), sizes
    share = F.create_map(*(F.lit(x) for label, n in sizes.items() for x in (str(label), min(1.0, per_label / n))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 40)) / float(1 << 40)
    return rows.where(draw < F.try_element_at(share, F.col("label").cast("string"))), sizes


def finish_once(rows: DataFrame, build: Callable[[Iterator[pa.RecordBatch]], dict[str, np.ndarray]]) -> bytes:
    """The model that ``build`` makes of all rows, statistics of bounded size, in one executor task.

    It must not depend on the rows' order.  No rows at all are built from, too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = io.BytesIO()
        np.savez(out, **build(batches))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])

    ship_package(rows.sparkSession)
    made = rows.repartition(1).mapInArrow(run, "model binary").first()
    return bytes(made["model"]) if made else next(run(iter(()))).column(0)[0].as_py()


def load_model(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}
