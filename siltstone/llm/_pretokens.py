"""Vectorised pre-tokenisation: numpy boundary masks in place of a regex engine.

The byte-level pattern splits text into contractions, runs of letters, numbers
or other signs (each with one leading space), and runs of white space.  Every
boundary depends on a character and its close neighbours only, so whole batches
of texts are cut by a few array operations over their code points.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from siltstone.llm._runtime import binary_column, ragged_take

LETTER, NUMBER, SPACE, OTHER, NONE = 0, 1, 2, 3, 9


@lru_cache(maxsize=2)
def char_classes(library: str) -> np.ndarray:
    """Class of each code point by the Unicode properties that the pattern names.

    The ``regex`` module may know a newer Unicode version than the library that
    defines the ids, so code points that this Python does not know are put to
    the library itself.
    """
    import unicodedata

    import regex

    points = np.arange(0x110000, dtype="<u4")
    points[0xD800:0xE000] = ord("!")
    everything = points.tobytes().decode("utf-32-le")
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, everything):
            out[m.start() : m.end()] = kind
    joins = _joins(library)
    for c in np.flatnonzero(out != OTHER).tolist():
        if unicodedata.category(chr(c)) == "Cn":
            out[c] = LETTER if joins("a", chr(c)) else NUMBER if joins("1", chr(c)) else OTHER
    return out


def _joins(library: str):
    """Whether the library keeps two characters in one pre-token."""
    import public_tokenizers

    if library == "tokenizers":
        import tokenizers

        level = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        return lambda a, b: len(level.pre_tokenize_str(a + b)) == 1
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)} | {x + bytes([b]): 256 * (k + 1) + b for k, x in enumerate((b"a", b"1")) for b in range(256)}
    own = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda a, b: own.encode_ordinary(a + b)[0] >= 256


def code_points(data: bytes, byte_offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, each text's first code point (with the end), byte offset of each (with the end)."""
    cp = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), "<u4")
    if len(cp) == len(data):
        return cp, byte_offsets, np.arange(len(cp) + 1)
    size = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    at = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    return cp, np.searchsorted(at, byte_offsets), at


def token_starts(cp: np.ndarray, firsts: np.ndarray, library: str, join_space: bool = True, single_numbers: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Indices where tokens start, and the class of every code point.

    ``firsts``: where each text starts; no token crosses a text's end.
    ``join_space``: one space before a run belongs to it, and of longer white
    space the last character stands apart; otherwise white space is a run that
    the caller drops.  ``single_numbers``: each number is a token.
    """
    n = len(cp)
    cls = char_classes(library)[cp]
    if not n:
        return np.zeros(0, np.int64), cls
    first = np.zeros(n + 1, bool)
    first[firsts] = True
    prev = np.empty_like(cls)
    prev[0], prev[1:] = NONE, cls[:-1]
    prev[first[:n]] = NONE
    start = cls != prev
    if single_numbers:
        start |= cls == NUMBER
    if join_space:
        after = np.flatnonzero(start & (cls != SPACE) & (prev == SPACE))
        start[after - 1] = True
        start[after[cp[after - 1] == 32]] = False
    quote = np.flatnonzero(start & (cp == 39))
    quote = quote[quote + 1 < n]
    quote = quote[(cls[quote + 1] == LETTER) & ~first[quote + 1]]
    if len(quote):
        one = cp[quote + 1]
        two = np.where((quote + 2 < n) & ~first[quote + 2], cp[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[quote[short | long] + 1] = False
        rest = np.concatenate((quote[short] + 2, quote[long] + 3))
        rest = rest[rest < n]
        start[rest[(cls[rest] == LETTER) & ~first[rest]]] = True
    return np.flatnonzero(start), cls


def split_texts(data: bytes, byte_offsets: np.ndarray, library: str) -> tuple[pa.Array, np.ndarray]:
    """All byte-level pre-tokens of the texts as binary values, and each text's first one (with the end)."""
    cp, firsts, at = code_points(data, byte_offsets)
    starts, _ = token_starts(cp, firsts, library)
    cuts = at[np.append(starts, len(cp))] if len(starts) else np.zeros(1, np.int64)
    return binary_column(data, cuts), np.searchsorted(starts, firsts)


class WordEncoder:
    """Ids of words, each encoded by a tokenizer library once while it is remembered.

    ``encode_words`` returns the ids of a list of words end to end, and their numbers.

    Two generations bound the memory: when the young one is full it becomes the
    old one.  Frequent words move over on use, so only rare ones are encoded anew.
    """

    def __init__(self, encode_words, most: int = 400_000):
        self.encode_words, self.most = encode_words, most
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        young, old = self.young, self.old
        out = list(map(young.get, words))
        if None in out:
            missing = [i for i, x in enumerate(out) if x is None]
            new = []
            for i in missing:
                if (x := old.get(words[i])) is None:
                    new.append(i)
                else:
                    out[i] = young[words[i]] = x
            for lo in range(0, len(new), 20_000):
                part = new[lo : lo + 20_000]
                flat, lengths = self.encode_words([words[i] for i in part])
                data, at = flat.astype("<u4", copy=False).tobytes(), 0
                for i, end in zip(part, (np.cumsum(lengths) * 4).tolist()):
                    out[i] = young[words[i]] = data[at:end]
                    at = end
            if len(young) > self.most:
                self.old, self.young = young, {}
        offs = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, out), np.int64, len(out)) >> 2, out=offs[1:])
        return np.frombuffer(b"".join(out), "<u4"), offs

    def encode_tokens(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a sequence of words, and the offset of each word's ids (with the end)."""
        coded = tokens.dictionary_encode()
        flat, offs = self.encode(coded.dictionary.to_pylist())
        return ragged_take(flat, offs, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))


def library_words(path: str):
    """Encoder of single pre-tokens by the tokenizers library: the file's model, without its own splitting."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tokenizers

    own = tokenizers.Tokenizer(tokenizers.Tokenizer.from_file(path).model)
    own.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    vocabulary = own.get_vocab()
    # A token has a character for each byte, and the model's mark where a word ends.
    mark = own.model.end_of_word_suffix or ""
    bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        bytes_of[i] = len(token.removesuffix(mark) if mark else token)

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # Words that are given as such are encoded apart, and many share one call's cost; their bytes tell them apart again.
        groups = [[w.decode("utf-8") for w in words[lo : lo + 2000]] for lo in range(0, len(words), 2000)]
        found = own.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False)
        flat = np.concatenate([np.array(x.ids, "<u4") for x in found])
        ends, at = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))), np.cumsum(bytes_of[flat])
        last = np.searchsorted(at, ends)
        if len(flat) and not (at[-1] == ends[-1] and (at[last] == ends).all()):
            raise ValueError(f"the tokens of {path} do not stand for the bytes of the words")
        return flat, np.diff(last, prepend=-1)

    return encode


@lru_cache(maxsize=8)
def added_tokens(path: str) -> dict[bytes, int]:
    """The strings that the file adds to its model, with their ids."""
    import json

    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens") or []
    if any(x[flag] for x in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("only added tokens that match the plain text are known")
    return {x["content"].encode(): x["id"] for x in added}


def cut_added(data: bytes, offs: np.ndarray, added: dict[bytes, int], end_id: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Texts as pieces without their added tokens: data, offsets, the id after each piece, each text's last piece.

    The id after a text's last piece is the end id.
    """
    n = len(offs) - 1
    if not any(x in data for x in added):
        return data, offs, np.full(n, end_id, np.uint32), np.arange(n)
    pattern = re.compile(b"|".join(map(re.escape, sorted(added, key=len, reverse=True))))
    pieces, after, last = [], [], []
    for lo, hi in zip(offs.tolist(), offs[1:].tolist()):
        for m in pattern.finditer(data, lo, hi):
            pieces.append(data[lo : m.start()])
            after.append(added[m[0]])
            lo = m.end()
        pieces.append(data[lo:hi])
        after.append(end_id)
        last.append(len(pieces) - 1)
    cuts = np.concatenate(([0], np.cumsum([len(x) for x in pieces]))).astype(np.int64)
    return b"".join(pieces), cuts, np.array(after, np.uint32), np.array(last, np.int64)


def rank_encoding(path: str):
    """The tiktoken library's encoding of a rank file."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


def rank_words(path: str):
    """Encoder of single pre-tokens by the tiktoken library from a rank file.

    A pre-token is not split again: the library's own splitting fails on very long
    runs of white space.
    """
    own = rank_encoding(path)

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = list(map(own._encode_single_piece, words))
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), "<u4", int(lengths.sum())), lengths

    return encode


def rank_texts(path: str):
    """Encoder of texts by the tiktoken library, splitting included."""
    own = rank_encoding(path)
    return lambda texts: [own.encode_ordinary(t.decode("utf-8")) for t in texts]


def read_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=8)
def shared_encoder(kind, path: str) -> WordEncoder:
    """One encoder for each Python worker, kept from task to task."""
    return WordEncoder(kind(path))
