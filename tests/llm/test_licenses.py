"""License scans against plain searching, and against the SQL twin on made texts."""

from __future__ import annotations

import random
import re

import duckdb
import pytest

from tableprep.llm import words
from tableprep.llm.licenses import BASE_PHRASES, SLACK, document_counts, find_licenses, license_report, templates, vocabulary
from tableprep.llm.queries import ORACLES, QUERIES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def found_words(text):
    return WORD.findall((text or "").translate(LOWER))


def starts(found, phrase):
    return [i for i in range(len(found) - len(phrase) + 1) if found[i : i + len(phrase)] == phrase]


def plain(rows):
    made = []
    for doc_id, text in rows:
        found = found_words(text)
        base = [(label, i) for phrase, label in BASE_PHRASES for i in starts(found, phrase.split())]
        labels, score = {label for label, _ in base}, 1.0 if base else 0.0
        for label, is_base, passage, ((first, main), *others) in templates():
            for at in [] if is_base else starts(found, main):
                s = at - first
                if all(any(abs(i - s - o) <= SLACK for i in starts(found, p)) for o, p in others):
                    same = sum(0 <= s + j < len(found) and found[s + j] == w for j, w in enumerate(passage))
                    labels.add(label)
                    score = max(score, same / len(passage))
        places = [i for _, i in base]
        made.append(
            (doc_id, len(found), len(base), min(places, default=None), max(places, default=None),
             ",".join(sorted({label for label, _ in base})), ",".join(sorted(labels)), score)
        )
    return sorted(made, key=str)


def result(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def made_texts(seed, n):
    """Passages, whole, cut, with words put in or changed, between other words."""
    rng = random.Random(seed)
    passages = [p for _, _, p, _ in templates()]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            passage = list(rng.choice(passages))
            for _ in range(rng.choice([0, 0, 1, 3])):
                at = rng.randrange(len(passage) + 1)
                passage[at:at] = ["MIT", "x", "the"][: rng.randrange(1, 4)] * rng.choice([1, 6])
            lo = rng.choice([0, 0, rng.randrange(len(passage))])
            parts += [rng.choice(["Other", "cc", "straße", "by"]) for _ in range(rng.randrange(5))] + passage[lo:]
        texts.append("".join((w.upper() if rng.random() < 0.2 else w) + rng.choice([" ", "\n", ", ", "-", "."]) for w in parts))
    return texts


EDGES = [(1, None), (2, ""), (3, "..."), (4, "CC BY"), (4, "CC BY"), (None, "cc by cc by 4.0"), (6, "straßemit license"), (7, "apache\xa0license")]


@pytest.mark.parametrize("size", [1 << 19, 10])
def test_report_of_made_texts(spark, monkeypatch, size):
    monkeypatch.setattr(words, "RUN_BYTES", size)
    rows = EDGES + [(100 + i, t) for i, t in enumerate(made_texts(1, 300))]
    docs = spark.createDataFrame([(*r, "x", True) for r in rows], "doc_id long, text string, licenses string, N_words boolean").coalesce(2)
    expected = plain(rows)
    assert result(license_report(docs)) == expected
    assert len({label for r in expected for label in r[6].split(",")}) >= len(templates())


def test_sql_twin_on_made_texts(spark):
    rows = EDGES + [(100 + i, t) for i, t in enumerate(made_texts(2, 200))]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    twin = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op13_license_scan']})").fetchall()
    assert sorted(twin, key=str) == plain(rows)


def test_word_counts_and_empty_table(spark):
    rows = [(i, t) for i, t in enumerate(made_texts(3, 50))] + [(0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = document_counts(docs)
    for word, i in vocabulary().items():
        assert counts[i] == sum(word.decode() in found_words(t) for _, t in rows)
    assert find_licenses(docs.limit(0)).count() == 0
    assert find_licenses(docs, keep=["text", "doc_id"]).columns == ["text", "doc_id", "n_words", "licenses"]


def test_query_on_given_documents(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert result(QUERIES["op13_license_scan"](spark, small)) == plain(rows)
