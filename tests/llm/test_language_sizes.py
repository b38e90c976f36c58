"""The fallback language follows the training texts of the table, not of the sample."""

from __future__ import annotations

from siltstone.llm import language_id
from siltstone.llm._training import load_model


def test_fallback_counts_the_whole_table(spark, monkeypatch):
    monkeypatch.setattr(language_id, "TRAINING_TEXTS", 5)
    rows = [(i, "the quick brown fox", "en") for i in range(300)] + [(i, "der schnelle braune fuchs", "de") for i in range(300, 360)]
    rows += [(i, "", "fr") for i in range(400, 900)] + [(i, None, "fr") for i in range(900, 999)] + [(999, "le renard brun", "fr")]
    for most in ("en", "de"):
        swap = {"en": most, "de": "de" if most == "en" else "en", "fr": "fr"}
        docs = spark.createDataFrame([(i, t, swap[x]) for i, t, x in rows], "doc_id bigint, text string, lang string")
        model = language_id.fit(docs)
        loaded = load_model(model)
        assert dict(zip(loaded["names"].tolist(), loaded["texts"].tolist())) == {most: 300, swap["de"]: 60, "fr": 1}
        assert language_id.identify(spark.createDataFrame([(1, "жжж")], "doc_id bigint, text string"), model).first().lang_pred == most
