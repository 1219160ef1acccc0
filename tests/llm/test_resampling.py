"""Importance resampling against plain counting and sorting."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tableprep.llm import words
from tableprep.llm.queries import QUERIES
from tableprep.llm.resampling import gram_runs, resample, resampling_report

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


def features(text, most=2):
    found = WORD.findall((text or "").translate(LOWER))
    return [" ".join(found[i : i + k]) for k in range(1, most + 1) for i in range(len(found) - k + 1)], len(found)


def plain(docs, target, share=25, least=20, buckets=10_000):
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t)[0])

    s, t = counts(x for _, x in docs), counts(target)
    s_all, t_all = s.total() + buckets, t.total() + buckets
    rows = []
    for doc_id, text in docs:
        grams, n = features(text)
        gains = [
            math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all)))
            for b in (zlib.crc32(f.encode()) % buckets for f in grams)
        ]
        weight = math.floor(sum(gains) / len(gains)) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    for rank, row in enumerate(able[: share * len(able) // 100], 1):
        row[4] = rank
    return sorted((tuple([*r[:4], r[4] if not isinstance(r[4], bool) else None]) for r in rows), key=str)


def result(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "straße", "日本語", "été", "x1", "the", "of", "naïve", "ÀB", "7"]
    return [
        "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "-", "\n", "'", " ", "\x85"]) for _ in range(rng.randrange(60)))
        for _ in range(n)
    ]


def test_report_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " - "), (4, "one"), (None, "a b " * 30), (6, "w " * 20), (6, "w " * 20), (6, "v " * 25)]
    rows += [(100 + i, t) for i, t in enumerate(corpus(1, 300))]
    target = corpus(2, 10) + [None, ""]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, score int, RANK string").repartition(5)
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    assert result(resampling_report(docs, items)) == plain(rows, target)
    drawn = {r[0] for r in plain(rows, target) if r[4] is not None}
    kept = resample(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted(r[0] or 0 for r in rows if r[0] in drawn)
    assert result(resampling_report(docs, items.limit(0))) == plain(rows, [])


def test_a_third_of_all_rows_alike(spark):
    rows = [(7, "same words here " * 8)] * 200 + [(i, t) for i, t in enumerate(corpus(3, 400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    assert result(resampling_report(docs, items, share=60)) == plain(rows, ["alpha beta"], share=60)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert resampling_report(docs, docs).count() == 0


@pytest.mark.parametrize("most", [1, 2, 3])
def test_runs_of_a_long_text_hold_the_same_grams(monkeypatch, most):
    text = " ".join(corpus(4, 40))
    whole = Counter(zlib.crc32(f.encode()) for f in features(text, most)[0])
    for size in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(words, "RUN_BYTES", size)
        runs = list(gram_runs(text.encode(), most))
        assert sum((c for _, c in runs), Counter()) == whole
        assert sum(n for n, _ in runs) == features(text)[1]


def test_query_on_given_documents(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert result(QUERIES["op12_importance_resampling"](spark, small)) == plain(docs, target)
