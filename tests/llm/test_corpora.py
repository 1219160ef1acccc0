"""Operators over whole corpora, against brute force on small ones."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from pyspark.sql import functions as F

from tableprep.llm import decontaminate, jaccard, language, ppm, queries, repeats, secrets, urls
from tableprep.llm.common import Rolling

DOCS = "doc_id long, text string, `Key` string, n_words string"
VOCABULARY = [f"{a}{b}{c}" for a in ("ba", "co", "du", "é", "ma") for b in ("ri", "to", "") for c in ("n", "s", "la", "")]


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "k", "w") for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def corpus(seed, documents=60):
    """Texts with shared passages, exact and near copies, odd ones."""
    rng = random.Random(seed)
    passage, line = prose(rng, 70), "All rights reserved. " * 4
    texts = []
    for i in range(documents):
        words = prose(rng, rng.randint(30, 160)).split()
        if i % 5 == 0:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        texts.append(" ".join(words) + ("\n" + line if i % 4 == 0 else ""))
    base = prose(rng, 140)
    texts += [base] * 4 + [base.upper()]
    for i in range(12):
        words = base.split()
        for _ in range(1 + i % 4):
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    return [*texts, "", None, " \n", "one", "one", "two words", "two  Words", "a" * 900, "ab" * 300, "x" * 199, "one two three four five"]


def word_lists(texts):
    return [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 300])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = random.Random(3)
    texts = corpus(1)
    items = [(i, " ".join(texts[i * 5].split()[4 : 4 + n])) for i, n in enumerate([10, 14, 30, 10, 11])]
    items += [(7, "changed"), (8, texts[0][:90]), (8, texts[0][:90]), (9, ""), (10, None), (None, prose(rng, 12)), (11, "one two three")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(frame(spark, texts), benchmark)
    assert found.columns[:3] == ["doc_id", "text", "Key"]
    out = {r["doc_id"]: r for r in found.collect()}
    windows = set()
    for (name, _), words in zip(items, word_lists([t for _, t in items])):
        for i in range(max(1, len(words) - 9)) if words else ():
            windows.add((str(name) if name is not None else "null", tuple(words[i : i + 10])))
    for i, words in enumerate(word_lists(texts)):
        hit, names = set(), set()
        for name, window in windows:
            for p in range(len(words) - len(window) + 1):
                if tuple(words[p : p + len(window)]) == window:
                    hit |= set(range(p, p + len(window)))
                    names.add(name)
        row = out[i]
        assert row["n_words"] == len(words)
        assert {q for r in row["hit_runs"] for q in range(r["start"], r["stop"])} == hit
        assert row["items"] == sorted(names)
        for m in row["matches"]:
            assert set(range(m["doc_start"], m["doc_start"] + m["n_words"])) <= hit
    clean = decontaminate.remove_contaminated(frame(spark, texts), benchmark)
    assert clean.columns == ["doc_id", "text", "Key", "n_words"]
    assert {r["doc_id"] for r in clean.collect()} == {i for i, r in out.items() if not r["hit_runs"]}
    nothing = decontaminate.contamination_report(frame(spark, texts), benchmark.limit(0)).collect()
    assert not any(r["contaminated"] for r in nothing) and nothing[0]["items_sha256"] == sha("")


def test_benchmark_of_long_and_repeated_items(spark, monkeypatch):
    """Size must not decide between a result and none: long items, heavy blocks and repeated rows as with one block."""
    rng = random.Random(9)
    texts = corpus(1)
    long = " ".join(f"{prose(rng, 12)} q{i}" for i in range(60))
    words = long.split()
    texts += ["x " + " ".join(words[40:300]) + " y", " ".join(words[10:25]), long]
    items = [(1, long), (2, " ".join(texts[0].split()[4:24]))] + [(3, texts[5])] * 9 + [(4 + i, prose(rng, 30)) for i in range(20)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    results = []
    for block in (decontaminate.BLOCK_BYTES, 400):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        found = decontaminate.find_contamination(frame(spark, texts), benchmark)
        assert dict(found.dtypes)["matches"] == "array<struct<item_id:string,item_start:int,doc_start:int,n_words:int>>"
        results.append({r["doc_id"]: (r["n_words"], r["hit_runs"], r["items"], r["matches"]) for r in found.collect()})
    assert results[0] == results[1]
    row = results[1][len(texts) - 3]
    assert [tuple(m) for m in row[3]] == [("1", 40, 1, 260)] and row[2] == ["1"]


def test_longest_match(spark):
    words = [f"w{i}" for i in range(40)]
    benchmark = spark.createDataFrame([("q", " ".join(words[5:30]))], "item_id string, text string")
    row = decontaminate.find_contamination(frame(spark, ["x " + " ".join(words)]), benchmark).first()
    assert [tuple(m) for m in row["matches"]] == [("q", 0, 6, 25)]


@pytest.mark.parametrize("length,width", [(200, 80), (24, 8)])
def test_repeats(spark, length, width):
    texts = corpus(2)
    out = {r["doc_id"]: r for r in repeats.repeat_report(frame(spark, texts), length, width).collect()}
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in bodies for p in range(len(b) - length + 1))
    for i, body in enumerate(bodies):
        mask = bytearray(len(body))
        for p in range(len(body) - length + 1):
            if seen[body[p : p + length]] > 1:
                mask[p : p + length] = b"\1" * length
        kept = bytes(c for c, gone in zip(body, mask) if not gone)
        row = out[i]
        assert (row["n_bytes"], row["n_removed"]) == (len(body), sum(mask)), i
        assert (row["n_spans"], row["kept_sha256"]) == (len(re.findall(b"\1+", bytes(mask))), sha(kept)), i


def test_repeats_of_repeated_rows(spark):
    text = prose(random.Random(5), 90)
    out = repeats.repeat_report(frame(spark, [text, text, text + "!", None], [1, 1, None, None])).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in out) == sorted([(len(text.encode()),) * 2] * 2 + [(len(text.encode()) + 1, len(text.encode())), (0, 0)])
    assert repeats.repeat_report(frame(spark, [text]).limit(0)).count() == 0


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain_components(sets):
    parent = list(range(len(sets)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return [root(a) for a in range(len(sets))]


def chained(seed):
    """Near copies in chains, where the ends are linked only through the middle, and many of one text."""
    rng = random.Random(seed)
    texts = []
    for _ in range(8):
        words = prose(rng, rng.randint(8, 120)).split()
        for step in range(6):
            texts.append(" ".join(words))
            at = rng.randrange(len(words))
            words[at : at + 1] = [f"new{step}"]
    common = prose(rng, 60)
    texts += [common + " " + prose(rng, n) for n in (1, 2, 3, 5, 8, 12, 16, 20, 24, 28)] * 2
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,sample,hubs", [(1, 20_000, 8), (2, 20_000, 0), (3, 0, 0), (4, 25, 1)])
def test_components(spark, monkeypatch, seed, sample, hubs):
    monkeypatch.setattr(jaccard.frequent_tokens, "__defaults__", (sample,))
    monkeypatch.setattr(jaccard, "HUBS", hubs)
    texts = corpus(seed) if seed == 1 else chained(seed)
    out = {r["doc_id"]: r for r in jaccard.near_duplicates(frame(spark, texts)).collect()}
    sets = [shingles(t) for t in texts]
    assert [(out[i]["n_shingles"], out[i]["component_id"]) for i in range(len(texts))] == [
        (len(s), c) for s, c in zip(sets, plain_components(sets))
    ]


def test_copies_spread_no_tokens(spark, monkeypatch):
    """A copied text gives its prefix tokens once per task, not once per row."""
    rows, made, write = [], {}, jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, label: made.setdefault(label, write(df, label)))
    for sid, times in ((1, 2000), (2, 1), (3, 300)):
        rows += [(i, 7, 9, sid, 4, [10, 11, 12, sid + 90]) for i in range(times)]
    sets = spark.createDataFrame(rows, "doc_id long, key long, n_shingles long, sid long, n_rare int, prefix array<long>").repartition(4)
    active = jaccard.active_tokens(sets).collect()
    assert sorted((r["token"], r["sid"], r["leader"]) for r in active) == [(t, s, 1) for t in (10, 11, 12) for s in (1, 2, 3)]
    assert made["met"].count() <= 3 * 3 * 4


def test_one_of_each(spark):
    rng = random.Random(9)
    text, other = prose(rng, 50), prose(rng, 50)
    docs = frame(spark, [text, text + " x", other, text, other, None, ""], [5, 3, 7, 3, 7, 9, None])
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 0), (True, 3), (True, 7), (True, 9)]
    assert jaccard.one_of_each(docs.limit(0)).count() == 0


def test_scores(spark, monkeypatch):
    texts = [t for t in corpus(4) if t is None or len(t) < 2000]
    docs = frame(spark, texts)
    train = [t or "" for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in train for w in t.encode().lower().split())
    total, kinds = sum(counts.values()) + len(train), len(counts) + 1
    results = []
    for common, grams in ((ppm.COMMON_WORDS, ppm.BLOCK_GRAMS), (5, 400)):
        monkeypatch.setattr(ppm, "COMMON_WORDS", common)
        monkeypatch.setattr(ppm, "BLOCK_GRAMS", grams)
        out = {r["doc_id"]: r for r in ppm.score_report(docs).collect()}
        results.append([out[i]["score"] for i in range(len(texts))])
        for i, text in enumerate(texts):
            words = (text or "").encode().lower().split()
            score = sum(math.log10((c + 1) / (total + kinds + 1)) for c in [*(counts[w] for w in words), len(train)])
            row = out[i]
            assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(words) + 1, sum(counts[w] > 0 for w in words) + 1, total)
            assert row["base_score"] == pytest.approx(score)
            assert row["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
    assert results[0] == pytest.approx(results[1])


def plain_ppm(train, text):
    """Method C with exclusion, symbol by symbol."""
    tree = defaultdict(Counter)
    for t in train:
        data = [*ppm.HEAD, *t, ppm.END]
        for i in range(3, len(data)):
            for order in range(4):
                tree[tuple(data[i - order : i])][data[i]] += 1
    data, total = [*ppm.HEAD, *text, ppm.END], 0.0
    for i in range(3, len(data)):
        ruled, p = set(), 1.0
        for order in (3, 2, 1, 0):
            left = {s: c for s, c in tree[tuple(data[i - order : i])].items() if s not in ruled}
            if not left:
                continue
            whole = sum(left.values()) + len(left)
            if data[i] in left:
                p *= left[data[i]] / whole
                break
            p *= len(left) / whole
            ruled |= set(left)
        else:
            p /= ppm.SYMBOLS - len(ruled)
        total += math.log(p)
    return total


def test_ppm_equals_plain():
    train = [b"abracadabra", b"alakazam", b"", b"abab"]
    leaves, counts = np.unique(ppm.grams(train)[0], return_counts=True)
    unigrams = np.bincount(leaves & 255, weights=counts, minlength=256)
    trie = ppm.Trie(leaves, counts, unigrams)
    for text in (b"abra", b"zzz", b"", "éa".encode(), b"alabama"):
        assert trie.log_probability(ppm.grams([text])[0]).sum() == pytest.approx(plain_ppm(train, text))


def test_ppm_sums_to_one():
    train = [b"abracadabra"]
    leaves, counts = np.unique(ppm.grams(train)[0], return_counts=True)
    trie = ppm.Trie(leaves, counts, np.bincount(leaves & 255, weights=counts, minlength=256))
    context = np.uint32(int.from_bytes(b"bra", "big") << 8)
    # two more symbols than bytes can never occur and hold the rest
    assert trie.probability(context | np.arange(256, dtype=np.uint32)).sum() == pytest.approx(1, abs=0.01)


PAGES = "page_id long, url string, html string"


def test_urls(spark):
    link = '<a href="https://bad.org/x">b</a> <a href=\'//BAD.org/y\'>c</a> <A HREF=/own>d</A>'
    rows = [
        (1, "http://A.example.com/en/1?x#y", None), (2, "https://www.example.com/en/", ""), (3, "http://x.net/fr/a", link),
        (4, "http://x.net/en/a", "<p>"), (5, "http://notcom/", None), (6, "x.com/en", None), (7, None, None), (8, "http://com/a://b", ""),
        (9, "http://example.com", ""), (10, "http://example.com#/en/", ""), (11, "http://bad.org/", None), (12, "http://good.org/", None),
        (13, "http://friend.org/", '<a href="http://y.net/q">'), (14, "http://y.net/es/", None), (14, "http://y.net/es/", None),
    ]
    out = urls.filter_urls(spark.createDataFrame(rows, PAGES).withColumnRenamed("html", "html")).collect()
    got = {r["page_id"]: tuple(r)[1:] for r in out}
    assert len(out) == len(rows)
    assert got[1] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert got[2] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[3] == ("x.net", "/fr/a", "net/fr/", "block")
    assert got[4][2:] == (None, "allow")  # half of the host's pages are blocked: just not enough
    assert got[5] == ("notcom", "/", None, "allow")
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[8] == ("com", "/a://b", "com/", "allow")
    assert got[9] == ("example.com", "", None, "allow") and got[10] == ("example.com", "", None, "allow")
    assert got[12][3] == "allow"
    assert got[13][3] == "block"  # links only to a host that is blocked throughout
    assert got[14] == ("y.net", "/es/", "net/es/", "block")
    assert urls.filter_urls(spark.createDataFrame([], PAGES)).count() == 0


def test_page_rank(spark):
    links = spark.createDataFrame([("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 1)], "source string, target string, links long")
    start = spark.createDataFrame([("trust", "a", 1.0), ("distrust", "c", 1.0)], "kind string, host string, seed double")
    ranks = {(r["kind"], r["host"]): r["rank"] for r in urls.propagate(start, urls.walks(links)).collect()}
    move = np.array([[0, 0, 1], [2 / 3, 0, 0], [1 / 3, 1, 0]])
    rank = np.array([0.15, 0, 0])
    for _ in range(urls.STEPS):
        rank = urls.DAMPING * move @ rank + np.array([0.15, 0, 0])
    assert [ranks["trust", h] for h in "abc"] == pytest.approx(rank.tolist())
    assert ranks["distrust", "c"] > ranks["distrust", "b"] > 0


def solved(links, start):
    """Personalised PageRank as the solution of the linear system."""
    hosts = sorted({h for a, b, _ in links for h in (a, b)} | set(start))
    at, out = {h: i for i, h in enumerate(hosts)}, Counter()
    for a, _, n in links:
        out[a] += n
    move = np.zeros((len(hosts), len(hosts)))
    for a, b, n in links:
        move[at[b], at[a]] += n / out[a]
    seed = np.array([start.get(h, 0.0) for h in hosts])
    return dict(zip(hosts, np.linalg.solve(np.eye(len(hosts)) - urls.DAMPING * move, (1 - urls.DAMPING) * seed).tolist()))


def plain_verdicts(pages):
    """Verdicts of ``(page_id, url, html)`` by rules and the solved linear systems; no host is near the threshold."""
    judged, links, share = [], Counter(), defaultdict(Counter)
    for page, url, html in pages:
        host, path = re.match(r"[^:]*://([^/?#]*)([^?#]*)", url).groups()
        host = host.lower()
        fits = [(len(r), v) for v, r in urls.RULES for name, _, p in [r.partition("/")]
                if ("." + host).endswith("." + name) and path.startswith("/" + p)]
        judged.append((page, host, max(fits)[1] if fits else None))
        share[host][judged[-1][2]] += 1
        for target in re.findall(r'(?i)href="[a-z]+://([^/"]+)', html or ""):
            links[host, target.lower()] += target.lower() != host
    edges = [(a, b, n) for (a, b), n in links.items() if n]
    part = lambda v: {h: c[v] / sum(c.values()) for h, c in share.items()}
    trust, distrust = solved(edges, part("allow")), solved([(b, a, n) for a, b, n in edges], part("block"))
    excess = {h: distrust[h] - trust[h] - urls.THRESHOLD for h in trust}
    assert all(abs(x) > 1e-6 or h not in dict(links) for h, x in excess.items())
    return {page: v or ("block" if excess[h] > 1e-9 else "allow") for page, h, v in judged}, edges


def linked(pages, seed=1):
    """The pages with links to other hosts added, a third of all links to one hub."""
    rng = random.Random(seed)
    hosts = sorted({re.match(r"[^:]*://([^/?#]*)", url)[1] for _, url, _ in pages})
    hub, out = rng.choice(hosts), []
    for page, url, html in pages:
        targets = [hub if rng.random() < 1 / 3 else rng.choice(hosts) for _ in range(rng.randint(0, 8))]
        out.append((page, url, (html or "") + "".join(f'<a href="https://{t}/x">x</a>' for t in targets)))
    return out


def test_urls_of_linked_pages(spark):
    """The given pages hold no links between hosts; with links the propagation decides verdicts."""
    rng = random.Random(6)
    rows = []
    for i in range(300):
        end = rng.choice(["com", "net", "net", "org", "org", "example.com"])
        rows.append((i, f"http://h{rng.randrange(60)}.{end}/{rng.choice(['en', 'es', 'fr'])}/{i}", "<a href='/own'>x</a>"))
    pages = linked(rows)
    expected, edges = plain_verdicts(pages)
    assert max(Counter(b for _, b, _ in edges).values()) > 30
    out = {r["page_id"]: r["verdict"] for r in urls.filter_urls(spark.createDataFrame(pages, PAGES)).collect()}
    assert out == expected
    alone = {r["page_id"]: r["verdict"] for r in urls.filter_urls(spark.createDataFrame(rows, PAGES)).collect()}
    assert sum(out[i] != alone[i] for i in out) > 5


def test_long_chains(spark):
    """Distrust of many blocked hosts reaches all hosts of a chain for which it exceeds the threshold."""
    bad, chain = [f"b{i}" for i in range(40)], [f"c{i}" for i in range(30)]
    edges = [(chain[0], b, 1) for b in bad] + [(a, b, 1) for b, a in zip(chain, chain[1:])] + [("c1", "c3", 2)]
    links = spark.createDataFrame(edges, "source string, target string, links long")
    start = spark.createDataFrame([("distrust", b, 1.0) for b in bad], "kind string, host string, seed double")
    ranks = {r["host"]: r["rank"] for r in urls.propagate(start, urls.walks(links)).collect()}
    full = solved([(b, a, n) for a, b, n in edges], dict.fromkeys(bad, 1.0))
    assert ranks == pytest.approx(full, abs=1e-6)
    assert full["c15"] > urls.THRESHOLD > full["c29"]
    assert urls.steps_needed(1e9) < 300


def test_rolling():
    data = np.frombuffer(b"abcabcabd", dtype=np.uint8)
    rolling = Rolling(data)
    at = np.arange(7)
    hashes = rolling.of(at, at + 3).tolist()
    assert len(set(hashes)) == 4 and hashes[:3] == hashes[3:6] and hashes[6] != hashes[0]


def test_pipeline_against_plain(spark, tmp_path):
    texts = corpus(6)
    rng = random.Random(8)
    texts += [prose(rng, 80) + " token = hunter2hunter2 " + prose(rng, 9), "!!! 123", None]
    rows = [(i, t, "xx", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    passage = " ".join(texts[0].split()[20:40])
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    models = language.fit_languages(docs)
    accepted = {r["doc_id"] for r in language.predict_languages(docs, models).where("NOT rejected").collect()}
    left = [i for i in range(len(texts)) if i in accepted]
    heads = plain_components([shingles(texts[i]) for i in left])
    left = [left[i] for i, head in enumerate(heads) if head == i]
    words = dict(zip(left, word_lists([texts[i] for i in left])))
    windows = {tuple(passage_words[i : i + 10]) for passage_words in word_lists([passage]) for i in range(len(passage_words) - 9)}
    left = [i for i in left if not any(tuple(words[i][p : p + 10]) in windows for p in range(len(words[i])))]
    table = queries.encode_pieces.__globals__["chunk_table"](public_tokenizers.path(corpus_pipeline.PIECES))
    assert sorted(out) == left
    assert 0 not in out and max(len(g) for g in (left,)) > 30
    for i in left:
        assert out[i]["ids"] == table.model.encode(secrets.redacted(texts[i], "[secret]"))


def test_registered_queries():
    names = {re.match(r"op\d+_", n)[0] for n in queries.QUERIES}
    assert names == {f"op{n}_" for n in range(1, 14)}
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_groups_are_opened_by_the_exact_bound(spark, monkeypatch):
    """Sets of one group each are no candidates unless they share what two sets of their sizes must."""
    from tableprep.llm import jaccard

    def least(x, y):
        outside = max(-(-3 * x // 4), -(-3 * y // 4)) - 1
        return max(1, -(-3 * (x + y) // 7) - outside)

    ranges = [(x, low, high) for x in range(1, 90, 4) for low in range(-(-3 * x // 4), 4 * x // 3 + 1) for high in range(low, 4 * x // 3 + 1)]
    if hasattr(jaccard, "least_in_any_prefix"):
        frame = spark.createDataFrame(ranges, "x int, low int, high int")
        bound = jaccard.least_in_any_prefix(F.col("x"), F.col("low"), F.col("high"))
        got = {(r[0], r[1], r[2]): r[3] for r in frame.select("x", "low", "high", bound).collect()}
        assert got == {(x, low, high): min(least(x, y) for y in range(low, high + 1)) for x, low, high in ranges}
    # thirty sets of 40 tokens, all holding the same few of their prefixes: one less than any pair must share
    few = least(40, 40) - 1
    rows = [(t, s, 40, s) for s in range(1, 31) for t in range(1, few + 1)]
    mixed = spark.createDataFrame(rows, "token long, sid long, n int, label long")
    sizes = {}
    real = jaccard.written

    def counted(df, label):
        out = real(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    assert jaccard.to_groups(mixed).count() == 0
    assert sizes["opened"] == 0
    enough = mixed.unionByName(spark.createDataFrame([(few + 1, s, 40, s) for s in (3, 7)], mixed.schema))
    assert [(r["a"], r["b"]) for r in jaccard.to_groups(enough).collect()] == [(3, 7)]


def test_groups_are_met_by_tokens_that_can_be_the_first_in_common(spark, monkeypatch):
    """Tokens too far behind in two sets' prefixes to be the first that they share do not pair them."""
    n, at = F.col("n"), F.col("at")
    positions = [(x, i) for x in range(1, 60) for i in range(x)]
    got = {(r["n"], r["at"]): r["most"] for r in spark.createDataFrame(positions, "n int, at int").select("n", "at", jaccard.reach_of(n, at).alias("most")).collect()}
    for x, i in positions:
        fitting = [y for y in range(1, 100) if -(-3 * (x + y) // 7) <= x - i]
        assert max([0, *fitting]) == max(0, got[x, i])
    sizes = {}
    real = jaccard.written

    def counted(df, label):
        out = real(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    # sets of 40 and of 31 tokens, two of them common: enough if they come first, too few behind others
    for places, pairs, met in ({40: (8, 9), 31: (0, 1)}, 15 * 15, 15 * 15 + 15 * 7), ({40: (9, 10), 31: (1, 2)}, 0, 15 * 7):
        rows = [(t, s, m, s, at) for s in range(1, 31) for m in [40 if s % 2 else 31] for t, at in enumerate(places[m])]
        mixed = spark.createDataFrame(rows, "token long, sid long, n int, label long, at int")
        mixed = mixed.withColumn("reach", jaccard.reach_of(F.col("n"), F.col("at"))).drop("at")
        assert jaccard.to_groups(mixed).count() == pairs
        assert sizes["met_groups"] == met


def test_frequent_tokens_are_found_in_many_documents(spark):
    """A passage of every tenth document is known as frequent however few documents are asked for at least."""
    rng = random.Random(5)
    passage = prose(rng, 12)
    texts = [prose(rng, 9) + (" " + passage if i % 10 == 0 else "") for i in range(1200)]
    order = jaccard.frequent_tokens(frame(spark, texts), 10)
    found = set(order.tokens.tolist())
    (known,) = jaccard.shingle_sets(jaccard.Chunk([passage.encode()]))
    assert set(known.tolist()) <= found


def test_copies_make_no_token_frequent(spark, monkeypatch):
    """Shingles of one text and its copies are left out of the frequent ones, which are limited in number."""
    rng = random.Random(6)
    copied, passage = prose(rng, 40), prose(rng, 12)
    texts = [copied] * 300 + [prose(rng, 9) + " " + passage for _ in range(30)]
    (known,) = jaccard.shingle_sets(jaccard.Chunk([passage.encode()]))
    monkeypatch.setattr(jaccard, "FREQUENT", len(known))
    order = jaccard.frequent_tokens(frame(spark, texts).repartition(4))
    assert dict(zip(order.tokens.tolist(), order.counts.tolist())) == dict.fromkeys(known.tolist(), 30)


def test_rare_tokens_have_no_more_holders_in_many_documents(spark):
    """As large a part of a corpus tells its frequent tokens where it is far larger than the least sample."""
    rng = random.Random(7)
    passages = [prose(rng, 12) for _ in range(150)]
    texts = [f"{prose(rng, 9)} {passage}" for passage in passages for _ in range(16)]
    found = set(jaccard.frequent_tokens(frame(spark, texts), 10).tokens.tolist())
    known = [set(tokens.tolist()) for tokens in jaccard.shingle_sets(jaccard.Chunk([p.encode() for p in passages]))]
    # of 16 holders, two or more are in a part of a fifth 86 times of 100, in one of a tenth 49 times
    assert sum(tokens <= found for tokens in known) > 0.7 * len(known)


def test_stages_hand_small_batches_to_python(spark, monkeypatch):
    """Every stage of the pipeline takes smaller batches than single operators, unless the session says otherwise."""
    setting, before = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.createDataFrame([(1, "some words of text", "en", "s", 18)], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("fit_languages", "predict_languages", "one_of_each", "remove_contaminated", "table", "redact_secrets", "encode_pieces"):
        monkeypatch.setattr(corpus_pipeline, name, lambda *a: docs.selectExpr("*", "false AS rejected", "text AS decoded", "array(1) AS ids"))
    try:
        for given, kept in (("67108864b", 1 << 20), (str(4 << 20), 1 << 20), (str(1 << 19), 1 << 19)):
            for _, stage in corpus_pipeline.STAGES:
                spark.conf.set(setting, given)
                stage(spark, docs, "")
                assert int(spark.conf.get(setting)) == kept
    finally:
        spark.conf.set(setting, before)
