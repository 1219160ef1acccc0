"""Languages with few labelled texts keep a model; more labels than the limit are refused."""

from __future__ import annotations

import random

import pytest

from tableprep.llm import language
from tableprep.llm.language import fit_languages, predict_languages


def words(seed: int, n: int) -> str:
    """Words over an alphabet of its own, so that a language differs from every other."""
    rng = random.Random(seed)
    letters = [chr(0x4E00 + 12 * seed + i) for i in range(12)]
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(n))


def test_two_hundred_languages_of_one_text(spark):
    rows = [(words(k, 40), f"l{k:03d}") for k in range(200)] + [(words(k, 40), "big") for k in range(1000, 1040)]
    docs = spark.createDataFrame([*rows, *rows[:50], (None, "x"), ("abc", None)], "text string, lang string").repartition(4)
    models = fit_languages(docs)
    assert models.names == sorted({lang for _, lang in rows})
    asked = spark.createDataFrame([(f"l{k:03d}", words(k, 25)) for k in range(0, 200, 7)], "own string, text string")
    got = predict_languages(asked, models).select("own", "lang_pred", "rejected").collect()
    assert all(r.own == r.lang_pred and not r.rejected for r in got)


def test_too_many_labels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 5)
    docs = spark.createDataFrame([(f"text {k}", f"l{k}") for k in range(6)], "text string, lang string")
    with pytest.raises(ValueError, match="more than 5"):
        fit_languages(docs)
    assert len(fit_languages(docs.limit(5)).names) == 5
