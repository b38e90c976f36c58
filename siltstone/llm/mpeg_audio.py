"""Media columns: MPEG audio.

``store_audio`` keeps any bytes losslessly in an MPEG-2 Layer III stream: the
granules are silent and each frame carries 576 payload bytes as ancillary data.
The stream has an ID3v2 tag, an ``Info`` table of frame count, byte count and
seek points, a CRC in every frame and an ID3v1 tag, all of them a function of
the payload alone, so equal texts have equal media.

``read_audio`` reads such a column, or any MPEG-1/2/2.5 stream of Layers I to
III: it skips tags, finds and re-finds frame headers, parses Xing, Info and VBRI
tables, checks CRCs (Layers I and III; Layer II's are counted as unchecked), and
returns exact duration and frame offsets for seeking.

Defined cases: null text is the empty text; the payload is never empty (at least
576 bytes); null media has null values; bytes without any frame have zero frames
and all bytes counted as skipped; free-format frames are not taken for frames.
Memory follows the longest single text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm._runtime import ship_package, utf8_slices

UNIT = 576
SLICE_BYTES = 2_000_000

# Fixed values of the MPEG audio standards: kbit/s by (MPEG-1?, layer), rates in Hz by version bits.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}

#: MPEG-2 Layer III with CRC, 144 kbit/s at 16 kHz, mono: 648 bytes a frame.
OWN_HEADER = bytes((0xFF, 0xF2, 0xD8, 0xC0))
FRAME, SIDE = 648, 9
MAIN = 4 + 2 + SIDE


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
        table.append(crc)
    return table


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    """The MPEG audio CRC: polynomial 0x8005, start value all ones."""
    crc = 0xFFFF
    for b in data:
        crc = (crc << 8 & 0xFFFF) ^ _CRC[crc >> 8 ^ b]
    return crc


class Header:
    """One decoded frame header; None from ``parse`` if the four bytes are none."""

    __slots__ = ("version", "layer", "protected", "kbps", "rate", "mono", "length", "samples", "side")

    @staticmethod
    def parse(b: bytes) -> Header | None:
        if len(b) < 4 or b[0] != 0xFF or b[1] & 0xE0 != 0xE0:
            return None
        version, layer, speed, rate = b[1] >> 3 & 3, 4 - (b[1] >> 1 & 3), b[2] >> 4, b[2] >> 2 & 3
        if version == 1 or layer == 4 or speed in (0, 15) or rate == 3:
            return None
        h = Header()
        first = version == 3
        h.version, h.layer, h.protected = version, layer, not b[1] & 1
        h.kbps, h.rate, h.mono = BITRATES[first, layer][speed], RATES[version][rate], b[3] >> 6 == 3
        padding = b[2] >> 1 & 1
        if layer == 1:
            h.samples, h.length = 384, (12_000 * h.kbps // h.rate + padding) * 4
        else:
            h.samples = 1152 if layer == 2 or first else 576
            h.length = h.samples // 8 * 1000 * h.kbps // h.rate + padding
        h.side = (17 if h.mono else 32) if first else (9 if h.mono else 17)
        return h

    def like(self, other: Header) -> bool:
        return (self.version, self.layer, self.rate) == (other.version, other.layer, other.rate)

    def covered(self) -> int | None:
        """Bytes after the CRC that it covers, None where that takes decoding."""
        if self.layer == 3:
            return self.side
        return (16 if self.mono else 32) if self.layer == 1 else None


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _text_frame(name: str, value: str) -> bytes:
    body = b"\0" + name.encode() + b"\0" + value.encode()
    return b"TXXX" + struct.pack(">I", len(body)) + b"\0\0" + body


def write_stream(payload: bytes) -> bytes:
    """The media form of unpadded payload bytes."""
    n = len(payload)
    units = max(1, -(-n // UNIT))
    frames = np.zeros((units + 1, FRAME), np.uint8)
    frames[:, :4] = np.frombuffer(OWN_HEADER, np.uint8)
    frames[:, 4:6] = np.frombuffer(struct.pack(">H", crc16(OWN_HEADER[2:] + bytes(SIDE))), np.uint8)
    body = np.full(units * UNIT, 255, np.uint8)
    body[:n] = np.frombuffer(payload, np.uint8)
    frames[1:, MAIN : MAIN + UNIT] = body.reshape(units, UNIT)
    info = b"Info" + struct.pack(">III", 15, units, frames.size) + bytes(k * 256 // 100 for k in range(100)) + struct.pack(">I", 0)
    frames[0, MAIN : MAIN + len(info)] = np.frombuffer(info, np.uint8)
    tag = _text_frame("payload_bytes", str(n))
    return b"ID3\x03\0\0" + _syncsafe(len(tag)) + tag + frames.tobytes() + b"TAG" + bytes(125)


def _id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """Length of the tag in front, and its user texts."""
    if data[:3] != b"ID3" or len(data) < 10 or any(x & 128 for x in data[6:10]):
        return 0, {}
    size = sum(x << s for x, s in zip(data[6:10], (21, 14, 7, 0)))
    end, at, texts = min(len(data), 10 + size), 10, {}
    while at + 10 <= end and data[at] != 0:
        raw = data[at + 4 : at + 8]
        length = sum(x << s for x, s in zip(raw, (21, 14, 7, 0))) if data[3] >= 4 else int.from_bytes(raw, "big")
        body = data[at + 10 : min(end, at + 10 + length)]
        if data[at : at + 4] == b"TXXX" and body[:1] in (b"\0", b"\3"):
            name, _, value = body[1:].decode("utf-8" if body[0] else "latin-1", "replace").partition("\0")
            texts[name] = value.rstrip("\0")
        at += 10 + length
    return end + (10 if data[5] & 16 else 0), texts


def _table(frame: bytes, h: Header) -> dict | None:
    """The Xing, Info or VBRI table in a first frame."""
    at = 4 + 2 * h.protected + h.side
    for kind in (b"Xing", b"Info"):
        for start in (at, 4 + h.side):
            if frame[start : start + 4] == kind and len(frame) >= start + 8:
                flags, at = int.from_bytes(frame[start + 4 : start + 8], "big"), start + 8
                out = {"kind": kind.decode()}
                for bit, name, width in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
                    if flags & bit and at + width <= len(frame):
                        out[name] = list(frame[at : at + width]) if name == "toc" else int.from_bytes(frame[at : at + 4], "big")
                        at += width
                return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width, per = struct.unpack(">IIHHHH", frame[46:62])
        toc = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc, "frames_per_entry": per}
    return None


def parse_stream(data: bytes) -> dict:
    """Tags, table, frame offsets and checks of an MPEG audio stream."""
    at, texts = _id3v2(data)
    end = len(data) - 128 if len(data) >= 128 and data[-128:-125] == b"TAG" else len(data)
    out = {"texts": texts, "id3v1": end < len(data), "table": None, "offsets": [], "samples": 0, "skipped": 0, "crc_ok": 0, "crc_bad": 0, "crc_unchecked": 0, "rate": None, "version": None, "layer": None, "kbits": 0}
    last: Header | None = None
    raw, h = b"", None
    checked: dict[bytes, int] = {}
    while at + 4 <= end:
        if (now := data[at : at + 4]) != raw or h is None:
            raw, h = now, Header.parse(now)
        fits = h is not None and at + h.length <= end and (last is None or h.like(last))
        if fits and last is None:
            following = Header.parse(data[at + h.length : at + h.length + 4]) if at + h.length < end else h
            fits = following is not None and following.like(h)
        if not fits:
            found = data.find(b"\xff", at + 1, end)
            found = end if found < 0 else found
            out["skipped"] += found - at
            at, last, h = found, None, None
            continue
        first = last is None and not out["offsets"] and out["table"] is None
        last = h
        if first and h.layer == 3 and (table := _table(data[at : at + h.length], h)):
            out["table"] = table
            out["version"], out["layer"], out["rate"] = VERSIONS[h.version], h.layer, h.rate
            at += h.length
            continue
        if h.protected:
            covered = h.covered()
            if covered is None:
                out["crc_unchecked"] += 1
            else:
                key = data[at + 2 : at + 4] + data[at + 6 : at + 6 + covered]
                if (crc := checked.get(key)) is None:
                    crc = crc16(key)
                    if len(checked) < 4096:
                        checked[key] = crc
                out["crc_ok" if crc == data[at + 4] << 8 | data[at + 5] else "crc_bad"] += 1
        out["offsets"].append(at)
        out["samples"] += h.samples
        out["kbits"] += h.kbps
        out["version"], out["layer"], out["rate"] = VERSIONS[h.version], h.layer, h.rate
        at += h.length
    out["skipped"] += max(0, end - at)
    return out


def seek_offsets(parsed: dict, points: int = 10) -> list[int]:
    """Byte offsets of the frames that start each of ``points`` equal parts of the stream."""
    offsets = parsed["offsets"]
    return [offsets[k * len(offsets) // points] for k in range(points)] if offsets else []


def payload_of(data: bytes, parsed: dict) -> bytes:
    """Padded payload of a stream that ``write_stream`` made."""
    offsets = np.asarray(parsed["offsets"], np.int64)
    raw = np.frombuffer(data, np.uint8)
    return raw[(offsets[:, None] + np.arange(MAIN, MAIN + UNIT))].tobytes() if len(offsets) else b""


def feature_text(parsed: dict) -> str:
    """Duration, checks, table and seek points as one line."""
    table = parsed["table"] or {}
    rate = parsed["rate"] or 0
    seconds = f"{parsed['samples']}/{rate}"
    frames = len(parsed["offsets"])
    return ";".join((
        f"mpeg{parsed['version']} layer{parsed['layer']}",
        f"duration={seconds}",
        f"frames={frames}",
        f"kbps={parsed['kbits'] / frames if frames else 0:g}",
        f"crc={parsed['crc_ok']},{parsed['crc_bad']},{parsed['crc_unchecked']}",
        f"skipped={parsed['skipped']}",
        f"table={table.get('kind')},{table.get('frames')},{table.get('bytes')}",
        "seek=" + ",".join(map(str, seek_offsets(parsed))),
    ))


def store_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each whole text's UTF-8 bytes as an MPEG audio stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in utf8_slices(batch.column(1), SLICE_BYTES):
                media = [write_stream(data[offs[i] : offs[i + 1]]) for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(media, pa.binary())], ["doc_id", "media"])

    ship_package(docs.sparkSession)
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id bigint, media binary")


READ_SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, duration_seconds double, seek_offsets array<bigint>"


def read_media(data: bytes | None) -> tuple:
    """One row of ``read_audio`` without the id."""
    if data is None:
        return (None,) * 9
    parsed = parse_stream(data)
    payload = payload_of(data, parsed) if parsed["rate"] == 16000 and "payload_bytes" in parsed["texts"] else b""
    n = int(parsed["texts"].get("payload_bytes", 0))
    seconds = parsed["samples"] / parsed["rate"] if parsed["rate"] else 0.0
    return (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature_text(parsed), seconds, parsed["offsets"])


def read_audio(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Payload digests, checks, exact duration and the offset of every frame of a media column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [read_media(x.as_py()) for x in part.column(1)]
                columns = list(zip(*rows))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    ship_package(media.sparkSession)
    return media.select(media[id_col].cast("bigint").alias("doc_id"), media[media_col].alias("media")).mapInArrow(run, READ_SCHEMA)
