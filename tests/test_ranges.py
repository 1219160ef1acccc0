"""Byte ranges of files against reading them whole."""

from __future__ import annotations

import csv
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprep.sources import ranges
from tableprep.sources.ranges import JsonArray, QuotedLines, first_character, json_lines
from tableprep.sources.tables import read_any, read_csv, read_json

PARTS = ['"', "\\", '\\"', "{", "}", "[", "]", "\n", "\r\n", "ü", "日", ",", ":", " ", "x", "}{", '""']


@pytest.fixture
def tiny_splits(spark):
    """Splits of a few hundred bytes, so that records, strings and pieces reach over many of them."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def objects(seed: int, n: int) -> list[dict]:
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 3, 12, 40])))
    return [
        {"id": i, "text": text(), "in": {"a": [{"b": text()}, {"b": None}], "c": rng.random()}, "s": text() * rng.choice([1, 1, 30])}
        for i in range(n)
    ]


def arrays(tmp_path, rows) -> str:
    styles = [{}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False}]
    folder = tmp_path / "arrays"
    folder.mkdir()
    for k, style in enumerate(styles):
        (folder / f"{k}.json").write_text("\n " * k + json.dumps(rows[k :: len(styles)], **style) + "\n" * k, encoding="utf-8")
    (folder / "empty.json").write_text("[ ]\n")
    return str(folder)


def test_json_arrays_in_tiny_splits(spark, tmp_path, tiny_splits):
    rows = objects(1, 120)
    path = arrays(tmp_path, rows)
    lines = [json.loads(r["value"]) for r in json_lines(spark, path).collect()]
    assert sorted(lines, key=lambda r: r["id"]) == rows
    read = read_json(spark, path)
    assert {(r["id"], r["text"], r["in"]["a"][0]["b"]) for r in read.collect()} == {(r["id"], r["text"], r["in"]["a"][0]["b"]) for r in rows}


def test_json_arrays_equal_whole_reading(spark, tmp_path):
    path = arrays(tmp_path, objects(2, 300))
    whole = spark.read.option("multiLine", True).json(path)
    split = read_json(spark, path)
    assert split.schema == whole.schema
    assert sorted(map(str, split.collect())) == sorted(map(str, whole.collect()))


def test_one_large_array_is_many_tasks(spark, tmp_path):
    path = tmp_path / "large.json"
    with open(path, "w") as out:
        out.write("[")
        for i in range(600_000):
            out.write(("," if i else "") + json.dumps({"id": i, "text": '}{"[\\ ' + "x" * 100}))
        out.write("]")
    assert path.stat().st_size > 64 << 20
    found = ranges.fragments(spark, str(path), JsonArray())
    sizes = [r["n"] for r in found.groupBy("range").agg(F.sum(F.length("value") + 1).alias("n")).collect()]
    assert len(sizes) >= 8 and max(sizes) < path.stat().st_size / 7
    lines = json_lines(spark, str(path))
    ids = lines.select(F.get_json_object("value", "$.id").cast("long").alias("id"), F.get_json_object("value", "$.text").alias("text"))
    assert ids.agg(F.count("*"), F.sum("id"), F.countDistinct("text")).first()[:] == (600_000, 600_000 * 599_999 // 2, 1)


def quoted(seed: int, n: int) -> list[list[str]]:
    rng = random.Random(seed)
    cell = lambda: "".join(rng.choice(PARTS) for _ in range(rng.choice([1, 3, 30, 200])))
    return [[str(i), "t" + cell() + "t", rng.choice(["", "plain", cell() + "."])] for i in range(n)]


def write_csv(path, rows, end="\n") -> None:
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out, lineterminator=end)
        writer.writerow(["id", "first\nname", "b"])
        writer.writerows(rows)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_csv_in_tiny_splits(spark, tmp_path, tiny_splits, end):
    rows = quoted(3, 150)
    write_csv(tmp_path / "a.csv", rows[:100], end)
    write_csv(tmp_path / "b.csv", rows[100:], end)
    (tmp_path / "b.csv").write_bytes((tmp_path / "b.csv").read_bytes().rstrip() + b"\n\n")
    read = read_csv(spark, str(tmp_path / "*.csv"))
    assert read.columns == ["id", "first\nname", "b"]
    got = sorted([str(r[0]), r[1], r[2] or ""] for r in read.collect())
    assert got == sorted(rows)


def test_one_large_quoted_file_is_many_tasks(spark, tmp_path):
    rows = [[str(i), f'line one {i}\nline "two"\n\n' + "y" * 200, "z"] for i in range(300_000)]
    write_csv(tmp_path / "large.csv", rows)
    read = read_csv(spark, str(tmp_path / "large.csv"), types={"id": "bigint", "first\nname": "string", "b": "string"})
    assert read.rdd.getNumPartitions() >= 8
    assert read.agg(F.count("*"), F.sum("id"), F.min("b"), F.sum(F.length("`first\nname`"))).first()[:] == (
        300_000, 300_000 * 299_999 // 2, "z", sum(len(r[1]) for r in rows),
    )


def test_scanners_in_parts_equal_whole():
    rng = random.Random(5)
    for scanner in (JsonArray(), QuotedLines()):
        for _ in range(200):
            raw = "".join(rng.choice(PARTS) for _ in range(60)).replace("\\", "").encode()
            cuts = [i + 1 for i, b in enumerate(raw) if b == ord(scanner.separator)]
            whole, inside, depth = scanner.ends(np.frombuffer(raw, dtype=np.uint8), False, 0)
            got, state, quotes = [], (False, 0), 0
            for i, j in zip([0, *cuts], [*cuts, len(raw)]):
                ends, *after = scanner.ends(np.frombuffer(raw[i:j], dtype=np.uint8), *state)
                n, outside_step, inside_step = scanner.effect(np.frombuffer(raw[i:j], dtype=np.uint8))
                assert after == [state[0] ^ (n % 2 == 1), state[1] + (inside_step if state[0] else outside_step)]
                state = tuple(after)
                got += (ends + i).tolist()
            assert (got, *state) == (whole.tolist(), inside, depth)


def test_escaped_quotes():
    raw = rb'"a\"b\\" "\\\"}" {"\\\\":1}'
    quotes = JsonArray().quotes(np.frombuffer(raw, dtype=np.uint8)).tolist()
    expected, escaped = [], False
    for i, b in enumerate(raw):
        if b == ord('"') and not escaped:
            expected.append(i)
        escaped = b == ord("\\") and not escaped
    assert quotes == expected


def test_header_names(spark, tmp_path):
    (tmp_path / "h.csv").write_text('a,A,,"x\ny"\n1,2,3,4\n')
    (tmp_path / "plain.csv").write_text("a,A,,x\n1,2,3,4\n")
    assert ranges.header_names('a,A,,"x\ny"') == ["a0", "A1", "_c2", "x\ny"]
    plain = spark.read.option("header", True).csv(str(tmp_path / "plain.csv"))
    assert plain.columns == ranges.header_names("a,A,,x")
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "h.csv")).collect()] == [(1, 2, 3, 4)]


def test_broken_and_odd_files(spark, tmp_path):
    (tmp_path / "cut.json").write_text('[{"id": 1}, {"id": 2}, {"id": 3, "t')
    assert {r["id"] for r in read_json(spark, str(tmp_path / "cut.json")).collect()} == {1, 2, None}
    (tmp_path / "none.json").write_text(" \n [\n]\n")
    assert json_lines(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "open.csv").write_text('id,t\n1,"a\nb"\n2,"never closed\n3,x\n')
    assert [r["id"] for r in read_csv(spark, str(tmp_path / "open.csv")).orderBy("id").collect()] == [1, 2]


def test_first_character(spark, tmp_path):
    import gzip

    (tmp_path / "bom").write_bytes(b"\xef\xbb\xbf\n  [1]")
    (tmp_path / "x.json.gz").write_bytes(gzip.compress(b'  [{"a": 1}, {"a": 2}]'))
    (tmp_path / "void").write_bytes(b"  ")
    assert [first_character(spark, str(tmp_path / f)) for f in ("bom", "x.json.gz", "void")] == ["[", "[", ""]
    assert sorted(r["a"] for r in read_json(spark, str(tmp_path / "x.json.gz")).collect()) == [1, 2]
    (tmp_path / "noname").write_text(json.dumps([{"a": 1}]))
    assert read_any(spark, str(tmp_path / "noname")).collect()[0]["a"] == 1
