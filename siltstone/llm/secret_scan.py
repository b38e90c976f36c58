"""Secret scans with a token-efficiency test.

Fixed patterns find assignments, access keys and hexadecimal runs.  Beyond them,
a long run of key characters is a secret if a tokenizer spends many tokens on it:
words and identifiers compress to several characters a token, random strings do
not.  Digests of known lengths, UUIDs and plain numbers are excluded first, and
identifiers whose parts are words to the tokenizer (in small letters, as it has
few capital ones) last; runs of letters alone are tested like all others.

Spans are (kind, start, end) in code points, end exclusive, ordered by start and
then by kind as listed in ``KINDS``.  Null text is the empty text and has no span;
repeated rows give repeated rows; whole texts are scanned however long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm._pretokens import rank_texts
from siltstone.llm._runtime import ship_package

KINDS = ("assign", "access", "hex", "random")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")

#: Lengths in hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 digests.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
HEXADECIMAL = re.compile(r"[0-9A-Fa-f]+")
#: Words, capitals and numbers as parts that separators join.
PARTS = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[_/+=-](?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+))*")
CHARS_PER_TOKEN = 2.2


#: Words of an identifier, and the letters from which one must be a word by itself.
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
LONG_WORD = 8


def is_known(run: str) -> bool:
    """Whether a run is a digest, a UUID or a number."""
    bare = run.strip("+/_=-")
    if HEXADECIMAL.fullmatch(bare) and len(bare) in DIGEST_LENGTHS or UUID.fullmatch(bare):
        return True
    return sum(c.isalpha() for c in bare) < 4


def word_parts(run: str) -> list[str]:
    """The words, in small letters, of a run that has the form of an identifier; else none."""
    bare = run.strip("+/_=-")
    if any(c.isdigit() for c in bare) and not (sum(c.isalpha() for c in bare) > 0.9 * len(bare) and PARTS.fullmatch(bare)):
        return []
    return [w.lower() for w in WORDS.findall(bare)]


class Scanner:
    """Finds spans; ``efficiency`` is the least characters a token of what isn't random."""

    def __init__(self, ranks_path: str | None, efficiency: float = CHARS_PER_TOKEN):
        self.encode = rank_texts(ranks_path) if ranks_path else None
        self.efficiency = efficiency

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind's place, end) of the fixed patterns, in order."""
        found = []
        if "=" in text or ":" in text:
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(found)

    def random(self, text: str) -> list[tuple[int, int, int]]:
        """Runs that the vocabulary encodes badly."""
        if self.encode is None:
            return []
        runs = [m for m in RUN.finditer(text) if not is_known(m[0])]
        if not runs:
            return []
        tokens = self.encode([m[0].encode() for m in runs])
        return [(m.start(), 3, m.end()) for m, ids in zip(runs, tokens) if len(m[0]) < self.efficiency * len(ids) and not self.is_words(m[0])]

    def is_words(self, run: str) -> bool:
        """Whether a run is an identifier of words: few tokens for all of them and for each long one."""
        words = word_parts(run)
        if not words:
            return False
        counts = [len(ids) for ids in self.encode([w.encode() for w in words])]
        if sum(map(len, words)) < self.efficiency * sum(counts):
            return False
        return all(len(w) < LONG_WORD or len(w) >= self.efficiency * n for w, n in zip(words, counts))

    def spans(self, text: str) -> tuple[list, list]:
        base = self.base(text)
        return base, sorted(base + self.random(text))


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, overlapping ones together, replaced by its first kind's mark."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s, k, e in spans:
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([s, k, e])
    for s, k, e in merged:
        out += [text[at:s], f"[{KINDS[k]} removed]"]
        at = e
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", efficiency: float = CHARS_PER_TOKEN) -> DataFrame:
    """(id, base spans, all spans) of every whole text; spans as joined strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(ranks_path, efficiency)
        for batch in batches:
            base, every = [], []
            for x in batch.column(1):
                a, b = scanner.spans(x.as_py() or "")
                base.append(join_spans(a))
                every.append(join_spans(b))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.string()), pa.array(every, pa.string())], ["doc_id", "base", "spans"])

    ship_package(docs.sparkSession)
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id bigint, base string, spans string")


def redact_secrets(docs: DataFrame, ranks_path: str, text_col: str = "text", efficiency: float = CHARS_PER_TOKEN) -> DataFrame:
    """The same rows with the secrets of ``text_col`` replaced by marks; null text stays null."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(ranks_path, efficiency)
        for batch in batches:
            texts = []
            for x in batch.column(place):
                if (text := x.as_py()) is not None and (spans := scanner.spans(text)[1]):
                    text = redact(text, spans)
                texts.append(text)
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([f.with_type(pa.string()) if i == place else f for i, f in enumerate(batch.schema)]))

    ship_package(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
