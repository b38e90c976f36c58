"""Language identification by bit-sliced Bloom filters of character n-grams.

Training counts the n-grams of each language where the texts are and keeps, for each
language, all those that are not much more frequent elsewhere.  All languages share
one filter of slots, sized by the largest language; a slot is a bitmask with a bit
for each language, and a language's n-gram sets its bit in K slots.  A look-up ANDs the masks of an n-gram's K slots and so returns all
languages that contain it at once.

A text's n-grams are looked up in whole arrays; each language's hits are its
popcount.  With n-grams N and the language's rate f of false positives, measured
from its fill, the members are (hits - f N) / (1 - f).  Divided by the share of
members that the language's own texts have, they decide; the score is the winner's
share of all languages'.

Defined cases: null text, and text without a letter, is ``und`` with score 0; a
text whose n-grams no language contains gets the language with most training texts
and score 0; ties go to the language that sorts first; null languages are not
learned; whole texts count; other columns are not read.  With no training text at
all every row is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._hashing import GOLDEN, U64, mix
from siltstone.llm._pretokens import LETTER, char_classes, code_points
from siltstone.llm._runtime import kept_rows, ship_package, utf8_slices
from siltstone.llm._training import finish_once, load_model, sample_by_label

ORDERS = (3, 4)
#: Texts of each language that training reads at most, chosen by a hash of the id.
TRAINING_TEXTS = 1500
#: Slots of the smallest filter, as a power of two, slots for each n-gram of a language, and hashes of one.
SLOT_BITS, SLOTS_A_GRAM, HASHES = 20, 32, 4
#: An n-gram belongs to a language where it is at least so frequent, relative to the language that has it most.
RELATIVE = 0.4
SLICE_BYTES = 1_000_000


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    """Lower case of each code point, where it is one code point; other signs than letters as a space."""
    points = np.arange(0x110000, dtype="<u4")
    points[0xD800:0xE000] = points[0x130] = 32
    low = np.frombuffer(points.tobytes().decode("utf-32-le").replace("Σ", "σ").lower().encode("utf-32-le"), "<u4").copy()
    low[char_classes("tiktoken") != LETTER] = 32
    return low


def gram_hashes(data: bytes, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts, each text's first (with the end), and whether a text has a letter.

    Runs of other signs than letters count as one space; each text has a space at
    both ends.  N-grams that start in a space's run and hold no letter are left out.
    """
    cp, firsts, _ = code_points(data, offs)
    n = len(firsts) - 1
    # A space before every text and one at the very end.
    chars = np.insert(_lower()[cp], firsts[:-1], 32)
    chars = np.append(chars, 32).astype(np.uint64)
    begins = firsts + np.arange(n + 1)
    owner = np.repeat(np.arange(n), np.diff(begins))
    space = chars == 32
    keep = np.ones(len(chars), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    edge = np.zeros(len(chars), bool)
    edge[begins] = True
    keep |= edge
    # A text's own last space gives way to the one that starts the next.
    keep[:-1] &= ~(space[:-1] & edge[1:] & ~edge[:-1])
    chars, owner = chars[keep], np.append(owner, n)[keep]
    space, edge = chars == 32, edge[keep]
    texts = np.searchsorted(owner, np.arange(n + 1))
    lettered = np.diff(np.concatenate(([0], np.cumsum(~space)))[texts]) > 0
    hashes, owners = [], []
    for order in ORDERS:
        size = max(0, len(chars) - order + 1)
        h = np.full(size, order, np.uint64)
        bad = np.zeros(size, bool)
        for j in range(order):
            h = h * U64(0x100000001B3) + chars[j : j + size]
            if 0 < j:
                # A window may end in the space that starts the next text, not go past it.
                bad |= edge[j : j + size] if j < order - 1 else edge[j : j + size] & ~space[j : j + size]
        bad |= space[:size] & space[1 : 1 + size]
        hashes.append(mix(h[~bad] * GOLDEN))
        owners.append(owner[:size][~bad])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(hashes)[order], np.searchsorted(owner[order], np.arange(n + 1)), lettered


def _slots(h: np.ndarray, k: int, size: int) -> np.ndarray:
    """The k-th slot of each hash among ``size``, by double hashing."""
    return ((h + U64(k) * (h >> U64(33) | U64(1))) & U64(size - 1)).astype(np.int64)


def count_grams(texts: pa.Array, labels: list) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
    """(label, n-grams, times) of runs of texts."""
    for lo, hi, data, offs in utf8_slices(texts, SLICE_BYTES):
        grams, firsts, _ = gram_hashes(data, offs)
        own = np.array([str(x) for x in labels[lo:hi]], dtype=object)
        for label in sorted(set(own)):
            chosen = np.concatenate([grams[firsts[i] : firsts[i + 1]] for i in np.flatnonzero(own == label)])
            yield label, *np.unique(chosen, return_counts=True)


def build(counted: Iterator[tuple[object, np.ndarray, np.ndarray]], sizes: dict) -> dict[str, np.ndarray]:
    """The bit-sliced filter of all languages, each's false-positive rate and own share of members.

    ``counted``: (label, n-grams, times) in any order; ``sizes``: each language's texts.
    """
    names = sorted(sizes)
    held: dict = {name: ([], []) for name in names}
    for label, h, n in counted:
        held[label][0].append(h)
        held[label][1].append(n)
    counts = []
    for name in names:
        grams, times = (np.concatenate([np.zeros(0, kind), *x]) for x, kind in zip(held.pop(name), (np.uint64, np.int64)))
        seen, back = np.unique(grams, return_inverse=True)
        counts.append((seen, np.bincount(back, times, len(seen)).astype(np.int64)))
    every = np.unique(np.concatenate([h for h, _ in counts])) if counts else np.zeros(0, np.uint64)
    most = np.zeros(len(every))
    places, rates = [], []
    for h, c in counts:
        places.append(np.searchsorted(every, h))
        rates.append(c / max(1, c.sum()))
        most[places[-1]] = np.maximum(most[places[-1]], rates[-1])
    kept = [r >= RELATIVE * most[at] for at, r in zip(places, rates)]
    size = 1 << max(SLOT_BITS, (SLOTS_A_GRAM * max((int(k.sum()) for k in kept), default=0) - 1).bit_length())
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if len(names) <= 8 * k().itemsize or k is np.uint64)
    masks = np.zeros((max(1, -(-len(names) // 64)), size), kind)
    share, wrong = np.ones(len(names)), np.zeros(len(names))
    for i, (h, r, own) in enumerate(zip((h for h, _ in counts), rates, kept)):
        for k in range(HASHES):
            masks[i // 64][_slots(h[own], k, size)] |= kind(1 << i % 64)
        wrong[i] = (masks[i // 64] >> kind(i % 64) & kind(1)).mean() ** HASHES
        share[i] = max(1e-9, r[own].sum())
    return {"names": np.array(names, dtype=str), "masks": masks, "share": share, "wrong": wrong, "texts": np.array([sizes[x] for x in names])}


def train(texts: list, labels: list, sizes: dict | None = None) -> dict[str, np.ndarray]:
    """A model of texts that are at hand; ``sizes``: the texts of each language, if those given are a sample."""
    sizes = sizes or {x: sum(label == x and bool(t) for t, label in zip(texts, labels)) for x in set(labels)}
    return build(count_grams(pa.array(texts, pa.string()), labels), {str(k): n for k, n in sizes.items()})


def predict(model: dict[str, np.ndarray], data: bytes, offs: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    names, masks = model["names"], model["masks"]
    n = len(offs) - 1
    grams, firsts, lettered = gram_hashes(data, offs)
    if not len(names):
        return ["und"] * n, np.zeros(n)
    total = np.diff(firsts)
    support = np.zeros((n, len(names)))
    for w, slots in enumerate(masks):
        found = slots[_slots(grams, 0, len(slots))]
        for k in range(1, HASHES):
            found &= slots[_slots(grams, k, len(slots))]
        for i in range(w * 64, min(len(names), w * 64 + 64)):
            run = np.concatenate(([0], np.cumsum(found >> slots.dtype.type(i % 64) & slots.dtype.type(1), dtype=np.int64)))
            hits = run[firsts[1:]] - run[firsts[:-1]]
            support[:, i] = np.maximum(0, (hits - model["wrong"][i] * total) / (1 - model["wrong"][i])) / model["share"][i]
    whole = support.sum(axis=1)
    best = np.where(whole > 0, support.argmax(axis=1), int(model["texts"].argmax()))
    score = np.divide(support.max(axis=1), whole, out=np.zeros(n), where=whole > 0)
    return [str(names[b]) if known else "und" for b, known in zip(best, lettered)], np.where(lettered, score, 0.0)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> bytes:
    """A model of (id, text, lang) rows; rows without text or language are left out."""
    ship_package(labelled.sparkSession)
    rows = labelled.select(labelled[id_col].alias("doc_id"), labelled[text_col].alias("text"), labelled[lang_col].cast("string").alias("label")).where("label IS NOT NULL AND doc_id IS NOT NULL AND text <> ''")
    sample, sizes = sample_by_label(rows, TRAINING_TEXTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, grams, times in count_grams(batch.column(1), batch.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(grams)), pa.array(grams.view(np.int64)), pa.array(times)], ["label", "gram", "times"])

    def finish(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        def counted():
            for batch in batches:
                coded = batch.column(0).dictionary_encode()
                which = coded.indices.to_numpy(zero_copy_only=False)
                grams, times = batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()
                for i, label in enumerate(coded.dictionary.to_pylist()):
                    yield label, grams[which == i], times[which == i]

        return build(counted(), sizes)

    counts = sample.select("label", "text").mapInArrow(count, "label string, gram bigint, times bigint")
    return finish_once(counts.groupBy("label", "gram").agg(F.sum("times").alias("times")), finish)


def identify(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load_model(shared.value)
        for batch in batches:
            for lo, hi, data, offs in utf8_slices(batch.column(1), SLICE_BYTES):
                names, scores = predict(own, data, offs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: bytes, least: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is known with a score of ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decide():
        own = load_model(shared.value)

        def holds(data: bytes, offs: np.ndarray) -> np.ndarray:
            names, scores = predict(own, data, offs)
            return (np.array(names, dtype=str) != "und") & (scores >= least)

        return holds

    return kept_rows(docs, text_col, decide)
