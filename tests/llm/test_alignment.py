"""Token alignment against plain whole-text encoding and counting."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tableprep.llm import alignment
from tableprep.llm.alignment import align_tokens, alignment_report, byte_letters
from tableprep.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows: list[tuple]) -> list[tuple]:
    """The report by whole-text encoding, spans of bytes and nested loops."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = byte_letters()
    made, counts = [], Counter()
    for key, text in rows:
        spans = {"a": [], "b": []}
        for side, ids, spell in (
            ("a", a.encode(" " + (text or ""), add_special_tokens=False).ids, lambda i: bytes(letters[c] for c in a.id_to_token(i))),
            ("b", b.encode(text or ""), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()),
        ):
            at = 0
            for i in ids if text else []:
                spans[side].append((i, at, at + len(spell(i)), spell(i)))
                at = spans[side][-1][2]
        if any(b"".join(s[3] for s in side) != (" " + (text or "")).encode() for side in spans.values()):
            spans = {"a": [], "b": []}
        cuts = sorted({s[2] for s in spans["a"]} & {s[2] for s in spans["b"]})
        groups, start = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(s[0]) for s in spans[k] if start < s[2] <= cut) for k in "ab"))
            start = cut
        links = []
        for i, from_, to, _ in spans["a"]:
            links += [(i, j) for j, lo, hi, _ in spans["b"] if lo < to and from_ < hi]
        counts.update(links)
        made.append((key, len(spans["a"]), len(spans["b"]), len(groups), links, ";".join(groups)))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return sorted(
        (
            (key, n_a, n_b, n, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
             hashlib.sha256(groups.encode()).hexdigest() if groups else "")
            for key, n_a, n_b, n, links, groups in made
        ),
        key=str,
    )


def report(df) -> list[tuple]:
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


WORDS = ["straße", "日本語", "😀😀", "don't", "<|endoftext|>", "<0x0A>", "1234", "é", "ŋ𓀀", "\x00", "x;\r", "a\xa0b", " ", "Thanhe", "()"]
SPACES = [" ", " ", " ", "\n", "  ", "\n\n", "\t", " \n ", "\r\n", "　", "\x1c"]


def texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) + rng.choice(SPACES) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


EDGES = [(1, None), (2, ""), (3, " "), (4, "\n"), (5, "a▁b"), (6, "▁"), (7, "x  "), (8, "  \n x"), (9, "a"), (9, "a"), (None, "a b")]


def test_alignment_of_odd_texts(spark):
    rows = EDGES + [(100 + i, t) for i, t in enumerate(texts(1, 120))]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, groups string, n_a int").repartition(3)
    assert report(alignment_report(docs, A, B)) == plain(rows)


def test_rare_pairs_segments_and_cleared_tables(spark, monkeypatch):
    monkeypatch.setattr(alignment, "HOT_PAIRS", 40)
    rows = EDGES + [(100 + i, t) for i, t in enumerate(texts(2, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert report(alignment_report(docs, A, B)) == plain(rows)


def test_parts_do_not_depend_on_sizes(monkeypatch):
    samples = [t.encode() for t in texts(3, 80)] + [None, b"", "a▁b " .encode() * 50, b"word " * 400 + "straße\n".encode()]

    def joined(piece: int, chunks: int, together: int):
        monkeypatch.setattr(alignment, "PIECE", piece)
        monkeypatch.setattr(alignment, "TABLE_CHUNKS", chunks)
        monkeypatch.setattr(alignment, "JOINED", together)
        monkeypatch.setattr(alignment.segments, "__defaults__", (piece,))
        made: dict[int, list] = {}
        for row, part, *counts, shown, links in alignment.Aligner(A, B).parts(samples):
            kept = made.setdefault(row, [[0] * 4, [], []])
            kept[0] = [x + y for x, y in zip(kept[0], counts)]
            kept[1].append(shown)
            kept[2] += links.tolist()
        return {k: (v[0], ";".join(v[1]), v[2]) for k, v in made.items()}

    usual = joined(1 << 19, 400_000, 512)
    assert usual == joined(40, 10, 3) == joined(1000, 1, 1)
    assert usual[82][0] == [0, 0, 0, 0]


def test_long_text_in_parts_has_one_digest(spark, monkeypatch):
    monkeypatch.setattr(alignment, "PIECE", 500)
    monkeypatch.setattr(alignment.segments, "__defaults__", (500,))
    rows = [(1, " ".join(texts(4, 40))), (2, "short"), (3, "a b▁ c" * 400)]
    aligned = align_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), A, B).collect()
    shown = {k: ";".join(r["groups"] for r in sorted(aligned, key=lambda r: r["part"]) if r["doc_id"] == k) for k in (1, 2, 3)}
    digests = {r["doc_id"]: r["groups_sha256"] for r in aligned if r["groups_sha256"] is not None}
    assert digests == {k: hashlib.sha256(v.encode()).hexdigest() if v else "" for k, v in shown.items()}
    assert report(alignment_report(spark.createDataFrame(rows, "doc_id long, text string"), A, B)) == plain(rows)


def test_empty_table(spark):
    assert alignment_report(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_query_on_given_documents(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert report(QUERIES["op11_token_alignment"](spark, small)) == plain(rows)
