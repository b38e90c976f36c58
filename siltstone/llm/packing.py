"""Cost-balanced packing of documents into sequences.

Attention makes a piece of n tokens cost ``linear * n + quadratic * n * n``.  Within a
group of documents, pieces go in descending length to the sequence of lowest
cost, relative to its length, that has room; a piece that fits nowhere is cut to
fill the sequence with the most room.  The sequences of a group are as long as the
group: full ones, and for the remainder one for each power of two in it, so no
token of padding is needed.

A group is a run of documents of about ``GROUP_TOKENS`` tokens within a partition:
packing needs no shuffle, and memory follows the group or the longest text.

Defined cases: null text is the empty text, whose document is the end id alone;
strings of the file's added tokens become their ids, as by the library's defaults;
null and repeated doc_id are kept, a document for each row; other columns are not
read.  Sequence numbers derive from the partition and are unique, not dense.
"""

from __future__ import annotations

import heapq
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from siltstone.llm._pretokens import SPACE, added_tokens, code_points, cut_added, library_words, shared_encoder, token_starts
from siltstone.llm._runtime import binary_column, ship_package, utf8_slices

GROUP_TOKENS = 1 << 20
SLICE_BYTES = 1_000_000
#: Cost a token, and cost a token for each token that it attends to, of a model of some 4,000 channels.
LINEAR, QUADRATIC = 1.0, 1 / 24_576


@lru_cache(maxsize=1)
def unsettled() -> np.ndarray:
    """Whether the library may normalise a code point otherwise than this Python, for all of them.

    Their tables follow different versions of Unicode.  So the library is asked for
    every code point: its lower case, its composed form, what its decomposition
    composes to, and its order among other combining marks.
    """
    from tokenizers import normalizers

    plain = [chr(c) for c in range(0x110000) if c != 10]
    kinds = list(map(unicodedata.category, plain))
    found = {c for c, kind in zip(plain, kinds) if kind == "Cn"}
    plain = [c for c, kind in zip(plain, kinds) if kind not in ("Cn", "Co", "Cs")]
    # Marks of the combining classes 1, 220 and 230.
    ordered = [(c, text) for c in plain if unicodedata.combining(c) for m in "\u0334\u0316\u0307" for text in (f"a{m}{c}", f"a{c}{m}")]
    probes = [(c, c) for c in plain] + [(c, unicodedata.normalize("NFD", c)) for c in plain] + ordered

    def differing(probes: list[tuple[str, str]], theirs, ours) -> set[str]:
        text = "\n".join(x for _, x in probes)
        return {c for (c, _), a, b in zip(probes, theirs(text).split("\n"), ours(text).split("\n")) if a != b}

    found |= differing(probes[: len(plain)], normalizers.Lowercase().normalize_str, lambda x: x.replace("Σ", "σ").lower())
    found |= differing(probes, normalizers.NFC().normalize_str, lambda x: unicodedata.normalize("NFC", x))
    out = np.zeros(0x110000, bool)
    out[list(map(ord, found))] = True
    return out


def normal_form(text: str) -> str:
    """The vocabulary's normal form of settled characters, but for white space, which its splitting drops."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


def library_form(text: str) -> str:
    """The same, by the library."""
    from tokenizers import normalizers

    return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(text)


def normalized(data: bytes, offs: np.ndarray) -> tuple[bytes, np.ndarray]:
    if data.isascii():
        return data.lower(), offs
    cp, firsts, _ = code_points(data, offs)
    odd = set((np.searchsorted(firsts, np.flatnonzero(unsettled()[cp]), side="right") - 1).tolist())
    parts = [(library_form if i in odd else normal_form)(data[a:b].decode("utf-8")).encode("utf-8") for i, (a, b) in enumerate(zip(offs, offs[1:]))]
    return b"".join(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def word_tokens(data: bytes, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words, single numbers and runs of signs of normalised texts; each text's first (with the end)."""
    cp, firsts, at = code_points(data, offs)
    starts, cls = token_starts(cp, firsts, "tokenizers", join_space=False, single_numbers=True)
    cuts = at[np.append(starts, len(cp))] if len(starts) else np.zeros(1, np.int64)
    keep = cls[starts] != SPACE
    return binary_column(data, cuts).filter(pa.array(keep)), np.searchsorted(starts[keep], firsts)


def tokenized(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[object, np.ndarray]]:
    """(doc id, ids with the end id) of every row."""
    encoder = shared_encoder(library_words, path)
    added = added_tokens(path)
    for batch in batches:
        for lo, hi, data, offs in utf8_slices(batch.column(1), SLICE_BYTES):
            data, offs, after, last = cut_added(data, offs, added, end_id)
            words, firsts = word_tokens(*normalized(data, offs))
            flat, at = encoder.encode_tokens(words)
            cuts = at[firsts]
            ids = np.insert(flat, cuts[1:], after)
            ends = np.concatenate(([0], cuts[1:][last] + last + 1))
            for i, doc in enumerate(batch.column(0).slice(lo, hi - lo).to_pylist()):
                yield doc, ids[ends[i] : ends[i + 1]]


def sequence_lengths(total: int, most: int) -> list[int]:
    """Full sequences, then one for each power of two in the rest."""
    rest = total % most
    return [most] * (total // most) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(lengths: list[int], most: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Pieces (document, start, length, sequence, offset) and the sequences' lengths."""
    sizes = sequence_lengths(sum(lengths), most)
    size = np.array(sizes, np.int64)
    room, cost = size.copy(), np.zeros(len(sizes))
    cost_of = lambda n: linear * n + quadratic * n * n
    queue = [(-n, d, 0) for d, n in enumerate(lengths) if n]
    heapq.heapify(queue)
    pieces = []
    while queue:
        n, d, start = heapq.heappop(queue)
        n = -n
        fits = np.flatnonzero(room >= n)
        if len(fits):
            s, take = int(fits[np.argmin(cost[fits])]), n
        else:
            s = int(np.argmax(room))
            take = int(room[s])
            heapq.heappush(queue, (take - n, d, start + take))
        pieces.append((d, start, take, s, int(size[s] - room[s])))
        room[s] -= take
        cost[s] += cost_of(take) / size[s]
    return pieces, sizes


_FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens")
SCHEMA = ", ".join(f"{x} bigint" for x in _FIELDS)


def pack_documents(docs: DataFrame, tokenizer_path: str, most: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: its document, place there, sequence and place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        group, held = [], 0

        def close() -> pa.RecordBatch:
            pieces, sizes = pack([len(ids) for _, ids in group], most)
            rows = [
                (group[d][0], start, n, zlib.crc32(group[d][1][start : start + n].tobytes()), len(group[d][1]), sequence + s, offset, sizes[s])
                for d, start, n, s, offset in sorted(pieces)
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], list(_FIELDS)), len(sizes)

        for doc, ids in tokenized(batches, tokenizer_path, end_id):
            group.append((doc, ids.astype("<u4", copy=False)))
            held += len(ids)
            if held >= GROUP_TOKENS:
                batch, used = close()
                yield batch
                sequence, group, held = sequence + used, [], 0
        if group:
            yield close()[0]

    ship_package(docs.sparkSession)
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)
