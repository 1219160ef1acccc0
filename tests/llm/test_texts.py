"""Operators on single texts: tokens, secrets, languages, statistics, chats, against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tableprep.llm import chat, language, pieces, quality, secrets
from tableprep.llm.common import Chunk

MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "  a  b ", "a\n\tb\r\n", "▁a ▁▁", "日本語 😀 ﬁ①", "x" * 5000, "a b " * 3000, "<s> </s> <0x41>", "a\0b", "é​ x"]
DOCS = "doc_id long, text string, lang string, source string, `IDS` string, `odd.name` int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, texts, extra="x"):
    return spark.createDataFrame([(i, t, "en", "s", extra, 7) for i, t in enumerate(texts)], DOCS)


def test_pieces_equal_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = pieces.encode_pieces(frame(spark, [*ODD, "a b", "a b"]), MODEL)
    assert out.columns == ["doc_id", "text", "lang", "source", "odd.name", "ids", "decoded"]
    for row in out.collect():
        ids = library.encode(row["text"] or "")
        assert (row["ids"], row["decoded"]) == (ids, library.decode(ids))
    assert pieces.encode_pieces(frame(spark, []), MODEL).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab ▁\n.é日😀\0T")), max_size=40))
def test_chunks_equal_the_library(text):
    table = pieces.chunk_table(MODEL)
    ids, decoded = table.encode([text.encode()])
    expected = table.model.encode(text)
    assert (ids[0].as_py(), decoded[0]) == (expected, table.model.decode(expected))


BASE = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 6),
    "access": (re.compile(r"(AKIA[A-Z0-9]+)"), 20),
    "hex": (re.compile(r"([0-9a-f]+)"), 24),
}


def plain_secrets(text):
    found = []
    for rank, (kind, (pattern, least)) in enumerate(BASE.items()):
        for m in pattern.finditer(text):
            if len(m[m.re.groups]) >= least:
                found.append((m.start(), rank, (kind, m.start(), m.end())))
    return [s for _, _, s in sorted(found)]


@settings(max_examples=300, deadline=None)
@given(
    st.lists(
        st.sampled_from(
            ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "AKIA", "=", ":", " ", '"', "'", "abc123", "0" * 24,
             "deadbeef" * 3, "A" * 16, "İ", "ſecret", "toKen", "x", "\n", "😀"]
        ), max_size=14,
    ).map("".join)
)
def test_base_spans(text):
    assert [s for s in secrets.secrets(text) if s[0] != "checked"] == plain_secrets(text)


def test_checksums_and_masks(spark):
    body = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
    good, bad = f"ghp_{body}{secrets.checksum(body)}", f"ghp_{body}000000"
    texts = [f"see {good}.", f"see {bad}.", "token = abcdefgh, AKIA" + "B" * 16, None, ""]
    found = {r["doc_id"]: r for r in secrets.secret_report(frame(spark, texts)).collect()}
    assert found[0]["spans"] == f"checked:4:{4 + len(good)}"
    assert found[1]["spans"] == ""
    assert (found[2]["n_assign"], found[2]["n_access"], found[2]["n_hex"]) == (1, 1, 0)
    assert found[3]["base_sha256"] == found[4]["base_sha256"] == sha("")
    masked = secrets.redact_secrets(frame(spark, texts))
    assert masked.columns == ["doc_id", "text", "lang", "source", "IDS", "odd.name"]
    out = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert out == {0: "see [secret].", 1: texts[1], 2: "[secret], [secret]", 3: None, 4: ""}


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    chars = sum(map(len, words))
    return [len(words), chars, sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), len(lines)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab \n\r\t\x0b#é日")), max_size=60), max_size=5))
def test_statistics(texts):
    made = quality.chunk_statistics(Chunk([t.encode() for t in texts])) if texts else [[]] * 6
    assert [list(map(int, c)) for c in zip(*made)] == [plain_statistics(t) for t in texts]


def test_quality_verdicts(spark):
    words = ["".join(chr(97 + (i * 7 + j) % 26) for j in range(3 + i % 5)) for i in range(400)]
    clean = [" ".join(words[i % 50 : i % 50 + 80 + i % 90]) for i in range(120)]
    junk = " ".join(w + "%%%***" for w in words[:120])
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}") for i, t in enumerate([*clean, junk, junk, "short", None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r["doc_id"]: r for r in quality.judge_quality(docs).collect()}
    assert len(out) == len(rows)
    assert sum(not out[i]["kept"] for i in range(120)) == 0
    assert not out[120]["kept"] and not out[121]["kept"] and out[120]["outlier"]
    assert all(out[i]["base_failed"] and not out[i]["kept"] and out[i]["distance"] is None for i in (122, 123, 124))
    assert quality.judge_quality(docs.limit(0)).count() == 0


def test_quality_finds_tables_and_menus(spark):
    """Symbols and repeated lines set a text apart in small groups too; length or one repeated line does not."""
    rng = random.Random(4)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(2000)]
             for lang, letters in {"fr": "aeiourstéèç", "de": "aeiunrsthäüß", "es": "aeosrnlñóí"}.items()}
    rows, kinds = [], []

    def add(kind, text, lang):
        rows.append((len(rows), text, lang, "s"))
        kinds.append(kind)

    for lang, own in words.items():
        prose = lambda n: " ".join(rng.choices(own, k=n))
        lines = lambda n: [prose(rng.randint(8, 20)) for _ in range(n)]
        for _ in range(60):
            add("clean", "\n".join(lines(rng.randint(5, 40))), lang)
        add("long", "\n".join(lines(1500)), lang)
        once = lines(3)
        add("one line twice", "\n".join([once[0], *once[1:], prose(45), once[0]]), lang)
        for _ in range(2):
            add("table", " | ".join(prose(2) for _ in range(60)), lang)
        for share in (60, 70, 80):
            distinct = [prose(2) for _ in range(100 - share)]
            menu = distinct + rng.choices(distinct, k=share)
            rng.shuffle(menu)
            add(f"menu {share}", "\n".join(menu), lang)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r["doc_id"]: r for r in quality.judge_quality(docs).collect()}
    assert not any(r["base_failed"] for r in out.values())
    assert {(kinds[i], r["kept"]) for i, r in out.items()} == {
        ("clean", True), ("long", True), ("one line twice", True), ("table", False), ("menu 60", False), ("menu 70", False), ("menu 80", False),
    }


def test_chi2():
    assert quality.chi2_cdf(quality.chi2_quantile(0.95, 5), 5) == pytest.approx(0.95)
    assert quality.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)


def test_languages(spark):
    alphabets = {"xx": "abcdefg", "yy": "uvwxyzé"}
    def text(lang, i):
        letters = alphabets[lang]
        return " ".join("".join(letters[(i * 3 + j * j + k) % 7] for k in range(2 + (i + j) % 5)) for j in range(40))

    rows = [(text(lang, i), lang) for i in range(150) for lang in alphabets] + [("ignored", None), (None, "xx"), ("", "yy")]
    models = language.fit_languages(spark.createDataFrame(rows, "text string, lang string"))
    assert models.names == ["xx", "yy"]
    asked = [text("xx", 500), text("yy", 501), None, "", "123 !?", "a", "ж" * 400, text("xx", 3) * 50]
    docs = spark.createDataFrame([(i, t, "zz") for i, t in enumerate(asked)], "doc_id long, text string, Score string")
    out = {r["doc_id"]: r for r in language.predict_languages(docs, models).collect()}
    assert [out[i]["lang_pred"] for i in (0, 1, 2, 3, 4, 5, 7)] == ["xx", "yy", "und", "und", "und", "xx", "xx"]
    assert [out[i]["rejected"] for i in range(8)] == [False, False, True, True, True, False, True, False]
    assert all(0 <= out[i]["score"] <= 1 for i in out)
    empty = language.fit_languages(spark.createDataFrame([], "text string, lang string"))
    assert {r["lang_pred"] for r in language.predict_languages(docs, empty).collect()} == {"und"}


def test_copied_texts_calibrate_once(spark):
    """A text copied many times does not become the only usual one, whichever side of the split it falls on."""
    rng = random.Random(2)
    words = ["".join(rng.choice("aeioursntl") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n, own: " ".join(rng.choices(own, k=n))
    texts = [prose(60, rng.sample(words, 250)) for _ in range(200)]
    clean = [prose(20_000, rng.sample(words, 250)) for _ in range(4)]
    frames = lambda rows: spark.createDataFrame([(i, t, "xx") for i, t in enumerate(rows)], "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    side = F.pmod(F.xxhash64("text", F.lit("calibrate")), F.lit(language.CALIBRATION)) == 0
    hot = frames(texts).where(side).first()["text"]
    alone, copied = (language.fit_languages(frames(rows)) for rows in (texts, [*texts, *[hot] * 3000]))
    assert copied.usual.tolist() == alone.usual.tolist()
    assert copied.usual[0][1] >= language.LEAST_SPREAD**2
    assert not any(r["rejected"] for r in language.predict_languages(frames(clean), copied).collect())


def test_language_models_are_distributions():
    import numpy as np

    text = b"the cat sat on the mat and the dog ran"
    grams, counts = np.unique(language.Grams([text]).keys, return_counts=True)
    model = language.KneserNey(grams, counts)
    context = np.uint64(ord("t") << 32 | ord("h") << 16 | ord("e"))
    symbols = np.array(sorted({int(k) & 0xFFFF for k in grams}), dtype=np.uint64)
    total = model.probability((context << np.uint64(16)) | symbols).sum()
    assert 0.8 < total <= 1.0 + 1e-9


TRICKY = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|> <\\\\|x", "", None, "a\nb", "日本 😀", "x" * 3000]


def test_chat_round_trip(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(TRICKY)]
    rows += [(2, 0, None, "hello"), (2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, None, "sys\ntem\\n<|", "first"), (None, 0, "user", "n")]
    rows += [(3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_turns(turns, RANKS, public_tokenizers.PATTERN)
    read = chat.read_turns(made, RANKS, public_tokenizers.PATTERN)
    got = {r["conv_id"]: r for r in chat.conversation_digests(read).collect()}
    for conv in {r[0] for r in rows}:
        mine = [(t, role or "", text or "") for c, t, role, text in rows if c == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))
        row = got[conv]
        loss = "".join(text for _, role, text in mine if role == "assistant")
        assert row["n_turns"] == len(mine)
        assert row["turns_sha256"] == sha("".join(f"{role}\n{text}\n" for _, role, text in mine))
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), sha(loss))
    places = made.where("conv_id = 1").orderBy("turn").collect()
    for before, after in zip(places, places[1:]):
        assert after["ids_start"] == before["ids_start"] + len(before["ids"])
    start = chat.template(RANKS, public_tokenizers.PATTERN).start
    assert all(r["ids"].count(start) == 1 and r["ids"].count(start + 1) == 1 for r in places)
    formatted = {r["turn"]: r["formatted"] for r in read.where("conv_id = 1").collect()}
    assert all(f.count("<|im_start|>") == 1 and f.count("<|im_end|>") == 1 for f in formatted.values())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("<|\\im_endx>\n")), max_size=30))
def test_escapes(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text)
    folded = chat.escape_role(text)
    assert chat.unescape_role(folded) == text and "\n" not in folded
