"""Seek offsets of a long media column."""

from __future__ import annotations

from helpers import documents

from siltstone.llm import mpeg_audio


def test_every_frame_has_an_offset(spark):
    text = "long " * 20_000
    stored = mpeg_audio.store_audio(documents(spark, [text, "short", ""])).cache()
    media = {r.doc_id: bytes(r.media) for r in stored.collect()}
    for r in mpeg_audio.read_audio(stored).collect():
        assert len(r.seek_offsets) == r.payload_bytes // 576
        assert all(media[r.doc_id][a] == 0xFF and media[r.doc_id][a + 1] >> 5 == 7 for a in r.seek_offsets)
        assert all(b - a == 648 for a, b in zip(r.seek_offsets, r.seek_offsets[1:]))
