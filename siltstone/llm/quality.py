"""Quality classifier: random-indexing word vectors and a two-layer numpy network.

Every word, and every word's shape (runs of letters, capitals, digits and single
signs), falls into one of a fixed number of hash buckets.  A bucket has a sparse
random index vector; its word vector is the sum of the index vectors around its
occurrences in the training texts, of length one, plus its own index vector.  A
text's features are the means of its words' and of its shapes' vectors and a few
pooled counts.  A network of one hidden layer learns from them, and a temperature
fitted on texts kept apart calibrates its probabilities.

The first layer is linear in the means, so scoring adds up rows of one table
(buckets x hidden units), which the model ships instead of the vectors.

Contexts are integers, summed where the texts are and then bucket range by bucket
range; features are made where the texts are, too, so one task gets only the labelled
texts' features, 134 numbers each, and trains the network.

Defined cases: null and empty texts have zero vectors and counts and get the score
that the network gives those; rows without label are not learned from; labels of
one document that differ are left out; with labels of one kind only, or none, the
score is the share of label 1 (0.5 without labels); whole texts count; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._hashing import _VALUES, U64, span_hashes, word_spans
from siltstone.llm._runtime import kept_rows, materialize, ship_package, shuffle_partitions, utf8_slices
from siltstone.llm._training import finish_once, load_model, sample_by_label

#: Labelled texts of each label that training reads at most, chosen by a hash of the id.
TRAINING_TEXTS = 5000
WORD_BUCKETS, SHAPE_BUCKETS = 1 << 16, 1 << 13
BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS
DIMENSIONS, NONZERO, WINDOW = 64, 4, 2
HIDDEN, EPOCHS, RATE, DECAY = 32, 30, 0.005, 1e-3
SLICE_BYTES = 1_000_000

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")


def buckets(data: bytes, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket and shape bucket of each word, each text's first word (with the end), pooled counts."""
    raw = np.frombuffer(data, np.uint8)
    starts, ends, firsts = word_spans(raw, offs)
    words = (span_hashes(_VALUES[raw], starts, ends) >> U64(48)).astype(np.int64) % WORD_BUCKETS
    kind = _SHAPE[raw]
    inside = np.zeros(len(raw) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    new = np.cumsum(inside[:-1]).astype(bool)
    new[1:] &= kind[1:] != kind[:-1]
    new[starts] = True
    run = np.concatenate(([0], np.cumsum(new)))
    shapes = WORD_BUCKETS + (span_hashes(_VALUES[kind[new]], run[starts], run[ends]) >> U64(51)).astype(np.int64) % SHAPE_BUCKETS
    n, count = len(firsts) - 1, np.diff(firsts)
    least = np.maximum(count, 1)
    owner = np.repeat(np.arange(n), count)
    distinct = np.bincount(np.unique(owner * BUCKETS + words) // BUCKETS, minlength=n)
    lines = np.concatenate(([0], np.cumsum(raw == 10)))[offs]
    size = ends - starts
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    pooled = np.stack((np.log1p(count), distinct / least, np.bincount(owner, again, n) / least, np.bincount(owner, size, n) / least, np.bincount(owner, size > 12, n) / least, np.log1p(np.diff(lines))), axis=1)
    return words, shapes, firsts, pooled


def index_vectors() -> np.ndarray:
    """The buckets' sparse random vectors of +1 and -1."""
    rng = np.random.default_rng(20)
    out = np.zeros((BUCKETS, DIMENSIONS), np.int8)
    rows = np.arange(BUCKETS)
    for _ in range(NONZERO):
        out[rows, rng.integers(0, DIMENSIONS, BUCKETS)] += rng.choice((-1, 1), BUCKETS).astype(np.int8)
    return out


def add_sums(sums: np.ndarray, keys: np.ndarray, values: np.ndarray) -> None:
    """Add the rows of ``values`` to the rows ``keys`` of ``sums``."""
    order = np.argsort(keys, kind="stable")
    where, first, times = np.unique(keys[order], return_index=True, return_counts=True)
    # Keys of many rows one by one, the others' first rows together, then their second ones and so on.
    many = 16
    for i in np.flatnonzero(times > many).tolist():
        sums[where[i]] += values[order[first[i] : first[i] + times[i]]].sum(axis=0, dtype=sums.dtype)
    where, first, times = (x[times <= many] for x in (where, first, times))
    for k in range(many):
        left = np.flatnonzero(times > k)
        sums[where[left]] += values[order[first[left] + k]]


def add_contexts(context: np.ndarray, index: np.ndarray, data: bytes, offs: np.ndarray) -> None:
    """Add to every bucket the index vectors around its occurrences in the texts."""
    words, shapes, firsts, _ = buckets(data, offs)
    if not len(words):
        return
    # Zeros between texts, so that no context crosses them; sums of four neighbours fit a byte.
    n = len(firsts) - 1
    place = np.arange(len(words)) + np.repeat(np.arange(1, n + 1) * WINDOW, np.diff(firsts))
    each = np.zeros((len(words) + (n + 1) * WINDOW, DIMENSIONS), np.int8)
    each[place] = index.take(words, axis=0) + index.take(shapes, axis=0)
    around = np.zeros_like(each)
    for d in range(1, WINDOW + 1):
        around[d:] += each[:-d]
        around[:-d] += each[d:]
    around = around.take(place, axis=0)
    for b in (words, shapes):
        add_sums(context, b, around)


def vectors_of(context: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Word vectors of buckets from their contexts and index vectors."""
    length = np.sqrt((context.astype(float) ** 2).sum(axis=1, keepdims=True))
    return (np.divide(context, length, out=np.zeros(context.shape), where=length > 0) + 0.5 * index.astype(float) / NONZERO**0.5).astype(np.float32)


def features_of(vectors: np.ndarray, data: bytes, offs: np.ndarray) -> np.ndarray:
    """Means of words' and shapes' vectors and pooled counts of each text."""
    words, shapes, firsts, pooled = buckets(data, offs)
    n = np.maximum(np.diff(firsts), 1)[:, None]
    return np.hstack((pooled_sums(vectors, words, firsts) / n, pooled_sums(vectors, shapes, firsts) / n, pooled))


def pooled_sums(table: np.ndarray, rows: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of the table's rows over each text."""
    out = np.zeros((len(firsts) - 1, table.shape[1]), np.float32)
    taken = table.take(rows, axis=0)
    ends = firsts.tolist()
    for i, (lo, hi) in enumerate(zip(ends, ends[1:])):
        if hi > lo:
            out[i] = taken[lo:hi].sum(axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(texts: list, labels: list) -> dict[str, np.ndarray]:
    """A model of texts that are at hand."""
    index = index_vectors()
    context = np.zeros((BUCKETS, DIMENSIONS), np.int64)
    slices = [x[2:] for x in utf8_slices(pa.array(texts, pa.string()), SLICE_BYTES // 4)]
    for data, offs in slices:
        add_contexts(context, index, data, offs)
    vectors = vectors_of(context, index)
    x = np.concatenate([features_of(vectors, *one) for one in slices])
    return train_network(vectors, x, np.array(labels, float), {v: labels.count(v) for v in (0, 1)})


def train_network(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, sizes: dict) -> dict[str, np.ndarray]:
    """The scoring table, the network and its temperature from the features and labels of a sample.

    ``sizes``: how many texts of each label there are in all.
    """
    share = sizes.get(1, 0) / max(1, sum(sizes.values())) if sizes else 0.5
    if len(set(y)) < 2:
        return {"constant": np.array(share)}
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - mean) / spread
    # Weights restore the labels' shares among all labelled rows.
    weight = np.where(y == 1, share / max(1e-9, y.mean()), (1 - share) / max(1e-9, 1 - y.mean()))
    rng = np.random.default_rng(11)
    apart = rng.random(len(y)) < 0.2
    if len(set(y[~apart])) < 2 or len(set(y[apart])) < 2:
        apart = np.zeros(len(y), bool)
    fit = np.flatnonzero(~apart)
    width = x.shape[1]
    p = [rng.normal(0, 1 / width**0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / HIDDEN**0.5, HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for lo in range(0, len(fit), 128):
            i = fit[lo : lo + 128]
            h = np.tanh(x[i] @ p[0] + p[1])
            e = weight[i] * (_sigmoid(h @ p[2] + p[3]) - y[i]) / len(i)
            back = np.outer(e, p[2]) * (1 - h * h)
            grads = [x[i].T @ back + DECAY * p[0], back.sum(axis=0), h.T @ e + DECAY * p[2], e.sum(keepdims=True)]
            step += 1
            for a, g, first, second in zip(p, grads, m, v):
                first += 0.1 * (g - first)
                second += 0.001 * (g * g - second)
                a -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    logits = np.tanh(x @ p[0] + p[1]) @ p[2] + p[3]
    temperature = 1.0
    if apart.any():
        grid = np.geomspace(0.25, 32, 85)
        loss = [np.sum(weight[apart] * np.logaddexp(0, np.where(y[apart] == 1, -1, 1) * logits[apart] / t)) for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
    first = p[0] / spread[:, None]
    bias = p[1] - mean @ first
    table = np.concatenate((vectors[:WORD_BUCKETS] @ first[:DIMENSIONS], vectors[WORD_BUCKETS:] @ first[DIMENSIONS : 2 * DIMENSIONS]))
    return {"table": table.astype(np.float32), "counts": first[2 * DIMENSIONS :], "bias": bias, "last": p[2], "offset": p[3], "temperature": np.array(temperature)}


def predict(model: dict[str, np.ndarray], data: bytes, offs: np.ndarray) -> np.ndarray:
    """Calibrated probability of label 1 of each text."""
    if "constant" in model:
        return np.full(len(offs) - 1, float(model["constant"]))
    words, shapes, firsts, pooled = buckets(data, offs)
    n = np.maximum(np.diff(firsts), 1)[:, None]
    inner = (pooled_sums(model["table"], words, firsts) + pooled_sums(model["table"], shapes, firsts)) / n + pooled @ model["counts"] + model["bias"]
    # Rounded, as the last bits of sums may follow a text's place in its batch.
    return _sigmoid(np.round((np.tanh(inner) @ model["last"] + model["offset"]) / model["temperature"], 9))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> bytes:
    """A model of the documents that have a label of 0 or 1."""
    known = (
        labels.select(labels["doc_id"].alias("doc_id"), labels[label_col].alias("label"))
        .where("label IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
    )
    present = known.join(docs.select(docs[id_col].alias("doc_id")), "doc_id", "left_semi").select("doc_id", "label")
    sample, sizes = sample_by_label(present, TRAINING_TEXTS)
    # The sample has about 2 * TRAINING_TEXTS ids at most, so it may be broadcast and the texts need no shuffle.
    chosen = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    spark = docs.sparkSession
    # Dealt evenly, whatever the table's files are.
    dealt = chosen.select("doc_id", "text", "label").repartition(shuffle_partitions(spark), F.xxhash64("doc_id", "text"))
    chosen = materialize(dealt, "training-texts")
    ship_package(spark)
    if len(sizes) < 2:
        return finish_once(chosen.select("label").limit(0), lambda batches: train_network(np.zeros(0), np.zeros((0, 0)), np.zeros(0), sizes))
    vectors = spark.sparkContext.broadcast(_vectors(chosen))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vectors.value
        for batch in batches:
            for lo, hi, data, offs in utf8_slices(batch.column(1), SLICE_BYTES // 4):
                rows = [row.astype("<f8").tobytes() for row in features_of(own, data, offs)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(rows, pa.binary())], ["doc_id", "label", "features"])

    def finish(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        x = np.array([np.frombuffer(r[2]) for r in rows]).reshape(len(rows), -1)
        return train_network(vectors.value, x, np.array([r[1] for r in rows], float), sizes)

    return finish_once(chosen.mapInArrow(featured, "doc_id bigint, label int, features binary"), finish)


def _vectors(texts: DataFrame) -> np.ndarray:
    """Vectors of all buckets, a table of fixed size (19 MB), from the contexts in the texts."""
    spark = texts.sparkSession
    ranges = 32
    size = BUCKETS // ranges

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        context = np.zeros((BUCKETS, DIMENSIONS), np.int32)
        for batch in batches:
            for _, _, data, offs in utf8_slices(batch.column(0), SLICE_BYTES // 4):
                add_contexts(context, index, data, offs)
        for k in range(ranges):
            own = context[k * size : (k + 1) * size]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], ["part", "payload"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                own = np.frombuffer(zlib.decompress(batch.column(1)[i].as_py()), np.int32).reshape(size, DIMENSIONS)
                k = batch.column(0)[i].as_py()
                sums[k] = own.astype(np.int64) if k not in sums else sums[k] + own
        index = index_vectors()
        for k, own in sums.items():
            made = vectors_of(own, index[k * size : (k + 1) * size])
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([made.tobytes()], pa.binary())], ["part", "payload"])

    packed = "part int, payload binary"
    parts = texts.select("text").mapInArrow(contexts, packed).repartition(min(ranges, shuffle_partitions(spark)), "part").mapInArrow(summed, packed)
    vectors = vectors_of(np.zeros((BUCKETS, DIMENSIONS), np.int32), index_vectors())
    for row in parts.collect():
        vectors[row.part * size : (row.part + 1) * size] = np.frombuffer(row.payload, np.float32).reshape(size, DIMENSIONS)
    return vectors


def score_quality(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load_model(shared.value)
        for batch in batches:
            for lo, hi, data, offs in utf8_slices(batch.column(1), SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(predict(own, data, offs))], ["doc_id", "score"])

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id bigint, score double")


def keep_quality(docs: DataFrame, model: bytes, least: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decide():
        own = load_model(shared.value)
        return lambda data, offs: predict(own, data, offs) >= least

    return kept_rows(docs, text_col, decide)
