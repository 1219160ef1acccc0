"""License scans: a positional index of rare words over license passages, then their mandatory phrases.

One pass counts in how many documents each word of the passages occurs; that orders the words of every
phrase by inverse document frequency.  In the second pass a file's words become places of license words.
Of each phrase whose words the file has, the rarest word is looked up first; its places, less the word's
offset in the phrase, are possible starts, and the postings of the next rarer words at their relative
positions thin them out until all words have agreed.  A passage is found where its main phrase stands and
its other mandatory phrases stand near the places that follow from it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.words import per_text, word_runs

SLACK = 20  # words by which other mandatory phrases may stand away from where they are expected

# Phrases that count as places, with their labels.
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Label, passage of the license or of its notice, mandatory phrases (the main one first).
PASSAGES = (
    ("agpl", "gnu affero general public license", ("gnu affero general public license",)),
    (
        "apache-notice",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
        "the license you may obtain a copy of the license at",
        ("licensed under the apache license", "in compliance with the license"),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met redistributions of source code must retain the above copyright notice this list of "
        "conditions and the following disclaimer",
        ("redistribution and use in source and binary forms", "the following conditions are met"),
    ),
    ("cc-by-4.0", "cc by 4 0", ("cc by 4 0",)),
    (
        "cc-by-legal",
        "this work is licensed under a creative commons attribution 4 0 international license",
        ("licensed under a creative commons attribution",),
    ),
    ("cc-by-nc", "cc by nc", ("cc by nc",)),
    ("cc-by-nd", "cc by nd", ("cc by nd",)),
    ("cc-by-sa", "cc by sa", ("cc by sa",)),
    (
        "cc0",
        "has waived all copyright and related or neighboring rights to this work",
        ("waived all copyright and related or neighboring rights",),
    ),
    ("gpl-2", "gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3", "gnu general public license version 3", ("gnu general public license version 3",)),
    (
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation",
        ("this program is free software", "under the terms of the gnu general public license"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
        ("for any purpose with or without fee is hereby granted", "this permission notice appear in all copies"),
    ),
    ("lgpl", "gnu lesser general public license", ("gnu lesser general public license",)),
    (
        "mit-terms",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    ("mpl-2", "mozilla public license v 2 0", ("mozilla public license",)),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        ("free and unencumbered software", "released into the public domain"),
    ),
)


def offset(passage: list[str], phrase: list[str]) -> int:
    """Where a phrase stands in its passage."""
    return next(i for i in range(len(passage)) if passage[i : i + len(phrase)] == phrase)


def templates() -> list[tuple[str, bool, list[str], list[tuple[int, list[str]]]]]:
    """(label, whether it is a base phrase, words, mandatory phrases with their offsets) of every passage."""
    made = [(label, True, phrase.split(), [(0, phrase.split())]) for phrase, label in BASE_PHRASES]
    for label, passage, phrases in PASSAGES:
        words = passage.split()
        made.append((label, False, words, [(offset(words, p.split()), p.split()) for p in phrases]))
    return made


@lru_cache(maxsize=1)
def vocabulary() -> dict[bytes, int]:
    words = sorted({w for _, _, passage, _ in templates() for w in passage})
    return {w.encode(): i for i, w in enumerate(words)}


def document_counts(docs: DataFrame, text: str = "text") -> list[int]:
    """In how many texts each license word occurs: one vector per task, summed by word."""
    known = vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = frozenset(known)
        counts = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for value in batch.column(0).cast(pa.binary()):
                found: set[bytes] = set()
                for run_ in word_runs(value.as_py()):
                    found |= words.intersection(run_)
                counts[[known[w] for w in found]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], names=["word", "n"])

    counted = docs.select(F.col(f"`{text}`")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    vector = [0] * len(known)
    for word, n in counted.collect():  # one row per license word
        vector[word] = n
    return vector


class Index:
    """Passages as word numbers; the words of every phrase from the rarest to the commonest."""

    def __init__(self, counts: list[int]):
        known = vocabulary()
        number = lambda words: [known[w.encode()] for w in words]
        self.templates = [(label, base, np.array(number(w)), [(o, tuple(number(p))) for o, p in ps]) for label, base, w, ps in templates()]
        phrases = {p for _, _, _, ps in self.templates for _, p in ps}
        rarity = lambda p: sorted(range(len(p)), key=lambda i: (counts[p[i]], i))
        self.postings = {p: [(p[i], i) for i in rarity(p)] for p in phrases}

    def places(self, ids: np.ndarray, present: set[int], phrase: tuple[int, ...]) -> np.ndarray:
        """All starts of a phrase: postings intersected by relative position, rarest word first."""
        if not present.issuperset(phrase):
            return np.zeros(0, dtype=np.int64)
        (word, shift), *others = self.postings[phrase]
        starts = np.flatnonzero(ids == word) - shift
        starts = starts[(starts >= 0) & (starts <= len(ids) - len(phrase))]
        for word, shift in others:
            if not len(starts):
                break
            starts = starts[ids[starts + shift] == word]
        return starts

    def find(self, ids: np.ndarray) -> list[dict]:
        """(label, base, start, stop, share) of every place of a passage, starts from 0, by start and label."""
        present = set(np.unique(ids).tolist())
        seen: dict[tuple[int, ...], np.ndarray] = {}
        found = []
        for label, base, words, ((first, main), *others) in self.templates:
            if main not in seen:
                seen[main] = self.places(ids, present, main)
            starts = seen[main] - first
            for shift, phrase in others:
                if not len(starts):
                    break
                if phrase not in seen:
                    seen[phrase] = self.places(ids, present, phrase)
                starts = starts[near(starts + shift, seen[phrase])]
            if len(starts):
                for start, share in zip(starts.tolist(), shares(ids, words, starts).tolist()):
                    stop = min(start + len(words), len(ids))
                    found.append({"label": label, "base": base, "start": max(start, 0), "stop": stop, "share": share})
        return sorted(found, key=lambda f: (f["start"], f["label"]))


def near(expected: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which expected places have a place at most ``SLACK`` words away."""
    return np.searchsorted(places, expected - SLACK, side="left") < np.searchsorted(places, expected + SLACK, side="right")


def shares(ids: np.ndarray, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The share of a passage's words that stand at their positions, for each of its starts."""
    same = np.zeros(len(starts), dtype=np.int64)
    for shift, word in enumerate(words.tolist()):
        at = starts + shift
        inside = (at >= 0) & (at < len(ids))
        same += inside & (ids[np.where(inside, at, 0)] == word)
    return same / len(words)


def find_licenses(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``keep`` (by default ``doc_id``), the number of words and all license passages found in every text.

    ``licenses`` lists (label, base, start, stop, share) by word numbers from 0, end exclusive; ``share`` is
    the share of the passage's words at their positions.  Null and empty texts have none, repeated rows
    are scanned one by one, a text is read in runs of words and held as one number per word.  Overlapping
    places all count.  Which words are rare is taken from all of ``docs``; it steers the order of look-ups
    only, so results do not depend on it.  Columns not kept are left out; an empty table gives no rows.
    """
    index = docs.sparkSession.sparkContext.broadcast(Index(document_counts(docs, text)))
    known = vocabulary()

    def compute(texts):
        get, find = known.get, index.value.find
        counts, found = [], []
        for value in texts:
            runs = [np.fromiter(map(get, run, repeat(-1)), dtype=np.int16, count=len(run)) for run in word_runs(value)]
            ids = np.concatenate(runs) if runs else np.zeros(0, dtype=np.int16)
            counts.append(len(ids))
            found.append(find(ids))
        return [counts, found]

    outputs = "n_words long, licenses array<struct<label:string,base:boolean,start:long,stop:long,share:double>>"
    return per_text(docs, keep or ["doc_id"], text, outputs, compute)


def license_report(docs: DataFrame) -> DataFrame:
    """Per document: base places, the first and last of them, labels, the best share of a passage."""
    found = find_licenses(docs)
    base = F.filter("licenses", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"])
    labels = lambda spans: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"]))))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("licenses")).alias("labels"),
        F.coalesce(F.array_max(F.transform("licenses", lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )
