"""Files, registry tables, whole-dataset runs and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tableprep import clean, plan_cleaning, plan_outliers, prepare_dataset, read_any, read_csv, read_json, read_table, write_table
from tableprep.operators.advice import parse_features, parse_report, parse_strategy, suggestions_of
from tableprep.operators.clean import CleaningPlan, FillStep
from tableprep.sources import registry
from tableprep.sources.synth import synth_table
from tableprep.sources.tables import dataset_name, format_of, infer_types, validate_shape
from tableprep.streaming.apply import apply_to_stream, file_stream, intake, write_stream
from tableprep.streaming.rate import ROCKSDB, admit_stream


def put(path, text):
    path.write_text(text)
    return str(path)


def test_csv_types_and_missing_texts(spark, tmp_path):
    uri = put(
        tmp_path / "a.csv",
        'i,x,b,t,none,big,q\n1,1.5,True,NA,,9007199254740993,"a, ""b"""\nNA,nan,FALSE,N/A x,null,12,"two\nlines"\n3,1e3,,,,7,None\n',
    )
    df = read_csv(spark, uri)
    assert dict(df.dtypes) == {
        "i": "bigint", "x": "double", "b": "boolean", "t": "string", "none": "double", "big": "bigint", "q": "string",
    }
    rows = [tuple(r) for r in df.collect()]
    assert rows == [
        (1, 1.5, True, None, None, 9007199254740993, 'a, "b"'),
        (None, None, False, "N/A x", None, 12, "two\nlines"),
        (3, 1000.0, None, None, None, 7, None),
    ]
    assert dict(read_csv(spark, uri, promote_int_nulls=True).dtypes)["i"] == "double"


def test_inference_of_near_misses(spark):
    rows = [("1", "1", "true", "99999999999999999999", "1."), ("2.5", "x", "1", "1", ".5")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    assert infer_types(df) == {"a": "double", "b": "string", "c": "string", "d": "double", "e": "double"}


def test_json_files_of_columns(spark, tmp_path):
    folder = tmp_path / "folder.json"
    folder.mkdir()
    put(folder / "a.json", json.dumps({"b": {"0": "x", "1": "y"}, "a": {"0": 1, "1": 2}}))
    put(folder / "b.json", json.dumps({"c": {"0": 7, "1": 8}, "a": {"0": 3, "1": 4}}))
    put(folder / "c.json", json.dumps({"a": {"0": 5}, "d": {}}))
    put(folder / "d.json", json.dumps({"row": [6, 9], "none": []}))
    read = read_json(spark, str(folder))
    assert read.columns == ["b", "a", "c", "d", "row", "none"]
    assert sorted(((r.a, r.b, r.c, r.row) for r in read.collect()), key=str) == [
        (1, "x", None, None), (2, "y", None, None), (3, None, 7, None), (4, None, 8, None), (5, None, None, None),
        (None, None, None, 6), (None, None, None, 9),
    ]


def test_json_shapes(spark, tmp_path):
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    array = put(tmp_path / "array.json", json.dumps(rows, indent=1))
    lines = put(tmp_path / "lines.json", "\n".join(json.dumps(r) for r in rows))
    for uri in (array, lines):
        assert sorted(r.a for r in read_json(spark, uri).collect()) == [1, 2]
    columns = put(tmp_path / "columns.json", json.dumps({"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": "y"}}))
    # one object of columns is a table too
    assert sorted((r.a, r.b) for r in read_json(spark, columns).collect()) == [(1, "x"), (2, "y")]


def test_dispatch(spark, tmp_path):
    assert [format_of(u) for u in ("a.CSV", "s3a://b/k/x.json?sig=1", "dir.parquet/", "x.txt", "noext")] == [
        "csv", "json", "parquet", None, None,
    ]
    with pytest.raises(ValueError, match="Unsupported file format"):
        read_table(spark, "/nowhere/x.txt")
    assert read_any(spark, put(tmp_path / "plain", "a,b\n1,2\n")).columns == ["a", "b"]
    assert read_any(spark, put(tmp_path / "jsonish", '\n {"a": 1}\n')).columns == ["a"]


def test_round_trip_keeps_booleans(spark, tmp_path):
    df = spark.createDataFrame([(1, True, "x"), (2, None, 'q"uote')], "i bigint, f boolean, t string")
    uri = write_table(df, str(tmp_path / "out.csv"), "csv")
    assert "True" in "".join(r.value for r in spark.read.text(uri).collect())
    assert sorted(read_table(spark, uri).collect()) == sorted(df.collect())


def test_shape_limits(spark):
    df = spark.range(11)
    validate_shape(df, 11, 1)
    with pytest.raises(ValueError, match="too large"):
        validate_shape(df, 10, 1)
    with pytest.raises(ValueError, match="too large"):
        validate_shape(df, None, 0)
    validate_shape(df, None, None)


def test_dataset_names(spark):
    cases = {
        "http://a.b/c/data.csv?x=1.json": "data",
        "http://a.b/c/data.v1.csv": "data.v1",
        "http://a.b/c/data": "dataset_from_url",
        "http://a.b/index.json": "dataset_from_url",
        "http://a.b/.hidden": "dataset_from_url",
        "http://a.b/data.csv/": "data",
        "default.csv": "dataset_from_url",
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r.u: r.n for r in df.select("u", dataset_name(F.col("u")).alias("n")).collect()} == cases


def test_synthetic_table(spark):
    df = synth_table(spark, 9, 4, seed=1)
    assert df.columns == ["numeric_col_0", "categorical_col_1", "float_col_2", "numeric_col_3"]
    rows = df.collect()
    assert [r.categorical_col_1 for r in rows] == list("ABCDABCDA")
    assert rows[0].float_col_2 == 0 and rows[-1].float_col_2 == 13.5
    assert all(abs(r.numeric_col_0 - i) < 6 for i, r in enumerate(rows))


def test_registry_append_and_latest(spark, tmp_path):
    root = str(tmp_path / "registry")
    first = spark.createDataFrame([("d1", "u", "uploaded", 1)], "id string, userId string, status string, extra int")
    registry.append(first, "Dataset", root)
    registry.append(first.withColumn("status", F.lit("failed")), "Dataset", root)
    rows = registry.latest(registry.read(spark, "Dataset", root)).collect()
    assert len(rows) == 1 and rows[0].status == "failed" and rows[0].createdAt is not None
    registry.append(spark.createDataFrame([("d1", "x")], "datasetId string, action string"), "FeatureLog", root)
    assert len(registry.read(spark, "FeatureLog", root).first().id) == 36


def _register(spark, root, path, mode="deep", name="d1"):
    row = spark.createDataFrame([(name, "u", mode, path)], "id string, userId string, mode string, rawDataPath string")
    registry.append(row.withColumn("status", F.lit("uploaded")), "Dataset", root)


def test_whole_dataset_run(spark, tmp_path):
    root, prefix = str(tmp_path / "registry"), str(tmp_path / "store")
    lines = ["id,kind,size"] + [f"{i},{'ab'[i % 2] if i % 5 else ''},{i if i % 4 else 'NA'}" for i in range(40)]
    (tmp_path / "store").mkdir()
    put(tmp_path / "store" / "raw.csv", "\n".join(lines) + "\n")
    _register(spark, root, "raw.csv")
    answer = '```json\n{"reasoning": "r", "summary": "s", "recommendations": ["one", "two"]}\n```'
    result = prepare_dataset(spark, root, "d1", prefix, "csv", report_answer=answer)
    assert result.df.columns == ["id", "size", "kind_a", "kind_b"]
    versions = registry.read(spark, "Dataset", root)
    assert sorted(r.status for r in versions.collect()) == ["completed", "processing", "uploaded"]
    final = registry.latest(versions).first()
    assert (final.status, final.rows, final.columns) == ("completed", 40, 4)
    assert read_table(spark, final.cleanedUrl).count() == 40
    assert registry.read(spark, "CleaningLog", root).count() == 2
    assert registry.read(spark, "GraphMetadata", root).filter("type = 'heatmap'").first().column is None
    report = registry.read(spark, "CleaningReport", root).first()
    assert (report.reasoning, report.recommendations) == ("r", "- one\n- two")


def test_unreadable_report_gets_the_standard_text(spark, tmp_path):
    root = str(tmp_path / "registry")
    _register(spark, root, put(tmp_path / "raw.csv", "a,b\n1,x\n,x\n3,\n4,x\n5,x\n"))
    prepare_dataset(spark, root, "d1", str(tmp_path), report_answer="no json here")
    report = registry.read(spark, "CleaningReport", root).first()
    assert report.summary == "Cleaned 2 columns with missing values. Data quality improved."


def test_failure_is_recorded_and_raised(spark, tmp_path):
    root = str(tmp_path / "registry")
    _register(spark, root, str(tmp_path / "missing.csv"))
    with pytest.raises(FileNotFoundError):
        prepare_dataset(spark, root, "d1", str(tmp_path))
    assert registry.latest(registry.read(spark, "Dataset", root)).first().status == "failed"
    with pytest.raises(LookupError):
        prepare_dataset(spark, root, "d2", str(tmp_path))


ANSWERS = [
    ('{"action": "mode", "reason": "x"}', "mode", "x"),
    ('text ```json\n{"action": "mean"}\n``` more', "mean", "No reason provided"),
    ('a ```\n{"reason": "r"}\n``` b ```json {"action": "unknown"} ```', "unknown", "No reason provided"),
    ('```\n{"reason": "r"}', "mean", "r"),
    ("[1, 2]", "median", "Default: median for numerical columns"),
    ("", "median", "Default: median for numerical columns"),
    ('{"action": "mode"} trailing', "median", "Default: median for numerical columns"),
    ('{"action": "mode"}, {"action": "mean"}', "median", "Default: median for numerical columns"),
    ('{"action": "mode",', "median", "Default: median for numerical columns"),
    ('{"action": null, "reason": "é \\" \\n"}', None, 'é " \n'),
]


def test_strategy_answers(spark):
    df = spark.createDataFrame([(i, a, "double") for i, (a, _, _) in enumerate(ANSWERS)], "i int, answer string, dtype string")
    out = parse_strategy(df).orderBy("i").collect()
    assert [(r.action, r.reason) for r in out] == [(a, b) for _, a, b in ANSWERS]


def test_feature_answers_feed_the_plan(spark):
    answer = (
        '```json\n{"encoding": [{"column": "t", "method": "label", "reason": "r"}], "drop": ["a", "b"], '
        '"new_features": [{"name": "AgeGroup", "description": "d"}], "scaling": "none"}\n```'
    )
    df = spark.createDataFrame([(1, answer), (2, "nothing")], "k int, answer string")
    found = suggestions_of(parse_features(df.filter("k = 1"), "k"))
    assert found.encoding == [{"column": "t", "method": "label", "reason": "r"}] and found.scaling == []
    assert [d["column"] for d in found.drop] == ["a", "b"]
    assert found.new_features == [{"name": "AgeGroup", "description": "d"}]
    assert parse_features(df.filter("k = 2"), "k").count() == 0


def test_report_answers(spark):
    answers = ['{"reasoning": "a", "recommendations": "plain"}', '{"recommendations": "[odd"}', "broken"]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, answer string")
    out = [tuple(r)[2:] for r in parse_report(df).orderBy("i").collect()]
    assert out == [
        ("a", "No summary provided", "plain"),
        ("No reasoning provided", "No summary provided", "[odd"),
        (None, None, None),
    ]


# ---------------------------------------------------------------- streams


@pytest.fixture
def folder(spark, tmp_path):
    """Three files of one table, arriving in order."""
    path = str(tmp_path / "arriving")
    for part in range(3):
        rows = [(part * 10 + i, None if i % 3 == 0 else float(i), "ab"[i % 2]) for i in range(10)]
        spark.createDataFrame(rows, "id bigint, x double, t string").coalesce(1).write.mode("append").parquet(path)
    return path


def test_stream_equals_batch(spark, folder, tmp_path):
    still = spark.read.parquet(folder)
    plan = plan_cleaning(still)
    moving = file_stream(spark, folder, still.schema, files_per_trigger=1)
    out = str(tmp_path / "out")
    write_stream(apply_to_stream(moving, plan), out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(spark.read.parquet(out).collect()) == sorted(clean(still)[0].collect())


def test_plans_that_look_at_other_rows_are_refused(spark, folder):
    still = spark.read.parquet(folder)
    moving = file_stream(spark, folder, still.schema)
    carrying = CleaningPlan([FillStep("x", "forward", "double")], [], ["id"])
    tail = still.withColumn("x", F.when(F.col("id") == 5, 1e6).otherwise(F.col("x")))
    removing = plan_outliers(tail, strategy="remove")
    assert removing.steps
    for plan in (carrying, removing):
        with pytest.raises(ValueError, match="cannot run on a stream"):
            apply_to_stream(moving, plan)


def test_intake_processes_each_key_once(spark, folder, tmp_path):
    schema = spark.read.parquet(folder).schema
    path = str(tmp_path / "processed")
    for delivery in ("a", "b", "b"):
        moving = file_stream(spark, folder, schema, files_per_trigger=1)
        query = intake(moving, "t", lambda b: b.select("t", F.lit(1).alias("seen")), path, str(tmp_path / f"cp-{delivery}"))
        query.awaitTermination()
    assert sorted(r.t for r in spark.read.parquet(f"{path}/batch=*").collect()) == ["a", "b"]


@pytest.mark.parametrize("lateness", [None, "1 hour"])
def test_admission_state_spans_triggers(spark, tmp_path, lateness):
    path = str(tmp_path / "requests")
    for part, times in enumerate([(0, 1, 2, 70), (3, 61, 62, 63), (64, 200, 201, 202)]):
        rows = [(part * 10 + i, "u", (1_700_000_000 + t) * 1_000_000) for i, t in enumerate(times)]
        spark.createDataFrame(rows, "id bigint, who string, t bigint").coalesce(1).write.mode("append").parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        moving = file_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
        out = str(tmp_path / "out")
        write_stream(admit_stream(moving, "who", "t", "id", 2, 60, lateness), out, str(tmp_path / "cp")).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    admitted = {r.id for r in spark.read.parquet(out).collect() if r.admitted}
    assert len(spark.read.parquet(out).collect()) == 12
    assert {0, 1, 3} <= admitted and 2 not in admitted and {21, 22} <= admitted and 23 not in admitted


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_rate_windows_in_any_session_zone(spark, tmp_path, zone):
    import random
    from datetime import datetime, timedelta

    from tableprep.streaming.rate import rate_windows

    rng = random.Random(4)
    start = datetime(2024, 3, 1, 10, 0, 0)
    rows = [(rng.randrange(3), start + timedelta(milliseconds=rng.randrange(1_200_000))) for _ in range(400)]
    spark.createDataFrame(rows, "u int, t timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        moving = file_stream(spark, str(tmp_path / "in"), "u int, t timestamp_ntz")
        counted = rate_windows(moving, "u", "t").withColumn("start", F.unix_micros("window_start"))
        write_stream(counted, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        got = {(r.u, r.start): r.requests for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    epoch = datetime(1970, 1, 1)
    latest = max((t - epoch) // timedelta(milliseconds=1) for _, t in rows) - 600_000
    expected: dict = {}
    for u, t in rows:
        at = (t - epoch) // timedelta(seconds=1)
        for i in range(6):
            edge = at - at % 10 - 10 * i
            if (edge + 60) * 1000 <= latest:
                expected[u, edge * 1_000_000] = expected.get((u, edge * 1_000_000), 0) + 1
    assert got == expected
    with pytest.raises(ValueError):
        rate_windows(moving, "u", "t", "60 seconds", "7 seconds")


def test_head(spark):
    from tableprep import head

    df = spark.createDataFrame([(3, "c"), (1, "a"), (None, "z"), (2, "b")], "n int, `a.b` string")
    assert [r[0] for r in head(df, 2, ["n"]).collect()] == [None, 1]
    assert [r[1] for r in head(df, 3, ["a.b"]).collect()] == ["a", "b", "c"]
    assert head(df).count() == 4 and head(df, 0).count() == 0
