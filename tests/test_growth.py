"""Plans that stay linear, ranges that stay even, runs that can be repeated, plans that can be stored."""

from __future__ import annotations

import threading
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tableprep import prepare, prepare_dataset, read_csv, read_json
from tableprep.operators.eda import correlation
from tableprep.operators.features import encode_labels, fit_labels
from tableprep.operators.ordered import RANGE, running, with_ranges
from tableprep.operators.rate import MICROS, admission
from tableprep.plans.store import load_plan, save_plan
from tableprep.session import exists, scratch_path, scratch_scope, together, written
from tableprep.sources import registry
from tableprep.streaming.apply import file_stream, intake


def scans(df, name: str) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count(name)


def test_label_columns_read_the_table_once(spark, tmp_path):
    rows = [(i, "hot" if i % 2 else f"v{i}", "x" if i % 3 else f"w{i}", f"u{i % 7}", None if i % 5 else f"t{i}") for i in range(3000)]
    path = str(tmp_path / "many")
    spark.createDataFrame(rows, "marker_id long, a string, b string, c string, d string").write.parquet(path)
    df = spark.read.parquet(path)
    columns = ["a", "b", "c", "d"]
    codes = fit_labels(df, columns, small=0)
    assert all(step.hot for step in codes)
    counts = []
    for k in (1, 2, 4):
        out = df
        for step in codes[:k]:
            out = step.apply(out)
        counts.append(scans(out, "Relation [marker_id"))
    assert counts == [1, 1, 1]
    got = {r["marker_id"]: r for r in encode_labels(df, columns, small=0).collect()}
    for j, c in enumerate(columns, 1):
        texts = ["nan" if r[j] is None else r[j] for r in rows]
        rank = {v: i for i, v in enumerate(sorted(set(texts)))}
        assert [got[r[0]][c] for r in rows] == [rank[t] for t in texts]


def test_small_dictionaries_are_bounded_together(spark, monkeypatch):
    from tableprep.operators import features

    df = spark.createDataFrame([(f"a{i:03d}", f"b{i:03d}", "c") for i in range(50)], "a string, b string, c string")
    monkeypatch.setattr(features, "SMALL_DICTIONARY_BYTES", 250)
    assert [s.small for s in fit_labels(df, ["a", "b", "c"])] == [True, False, True]


def test_ranges_stay_even_behind_a_common_start(spark):
    start = "same " * 400  # keys of 2 KB
    df = spark.range(40_000).select(F.concat(F.lit(start), F.lpad(F.col("id").cast("string"), 5, "0")).alias("k"), "id").repartition(5)
    began = time.time()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one partition
    try:
        ranged = with_ranges(df, ["k"], 10)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in ranged.groupBy(RANGE).count().collect()]
    assert len(sizes) >= 4000 and max(sizes) == 10
    spread = ranged.groupBy((F.shiftright(RANGE, 33)).alias("part")).count().toPandas()["count"]
    assert len(spread) > 1 and spread.max() < 3 * spread.mean()
    assert [r["k"][-5:] for r in ranged.orderBy(RANGE, "k").limit(3).collect()] == ["00000", "00001", "00002"]
    assert time.time() - began < 60


def test_thousands_of_ranges(spark):
    df = spark.range(60_000).select("id", (F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v")).repartition(7)
    began = time.time()
    out = running(df, [], ["id"], sums={"n": F.lit(1)}, lasts={"last": F.col("v")}, rows_per_range=2)
    wrong = out.filter((F.col("n") != F.col("id") + 1) | (F.col("last") != F.col("id") - F.col("id") % 7))
    assert out.count() == 60_000 and wrong.isEmpty()
    assert time.time() - began < 60


def test_counts_beyond_integers(spark, tmp_path):
    root = str(tmp_path / "registry")
    big = 3_000_000_000
    registry.append(spark.createDataFrame([("d", big)], "id string, rows long"), "Dataset", root)
    registry.append(spark.createDataFrame([("d", "c", big)], "datasetId string, column string, nullCount long"), "CleaningLog", root)
    registry.append(spark.createDataFrame([("d", "c", big)], "datasetId string, column string, outlierCount long"), "OutlierLog", root)
    assert registry.read(spark, "Dataset", root).first().rows == big
    assert registry.read(spark, "CleaningLog", root).first().nullCount == big
    assert registry.read(spark, "OutlierLog", root).first().outlierCount == big


def test_ties_in_versions_are_decided(spark):
    rows = [("a", "2024-01-01", s) for s in ("x", "y", "z")]
    df = spark.createDataFrame(rows, "id string, updatedAt string, status string")
    picks = {registry.latest(df.repartition(n)).first().status for n in (1, 2, 3)}
    assert len(picks) == 1


def test_runs_can_be_repeated(spark, tmp_path, monkeypatch):
    from tableprep.plans import prepare as module

    root, store = str(tmp_path / "registry"), str(tmp_path / "store")
    raw = str(tmp_path / "raw.csv")
    lines = ["id,kind,size"] + [f"{i},{'ab'[i % 2] if i % 5 else ''},{i if i % 4 else 'NA'}" for i in range(40)]
    with open(raw, "w") as out:
        out.write("\n".join(lines) + "\n")
    row = spark.createDataFrame([("d1", "u", "deep", "uploaded", raw)], "id string, userId string, mode string, status string, rawDataPath string")
    registry.append(row, "Dataset", root)
    prepare_dataset(spark, root, "d1", store)

    def broken(spark, path, *_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        original = registry.append

        def failing(df, table, where):
            if table == "FeatureLog":
                raise RuntimeError("lost")
            original(df, table, where)

        patched.setattr(module.registry, "append", failing)
        with pytest.raises(RuntimeError):
            prepare_dataset(spark, root, "d1", store)
    result = prepare_dataset(spark, root, "d1", store)
    versions = registry.read(spark, "Dataset", root)
    final = registry.latest(versions).first()
    assert final.status == "completed" and final.rows == 40
    logs = registry.read(spark, "CleaningLog", root)
    assert logs.count() == 6
    assert sorted(r.column for r in registry.current_logs(logs, versions).collect()) == ["kind", "size"]
    # what the result holds survives the run's scratch files
    assert result.df.count() == 40 and result.eda.histogram.count() > 0
    assert sorted(map(str, result.plan.apply(read_csv(spark, raw)).collect())) == sorted(map(str, result.df.select(*result.df.columns).collect()))


def test_scratch_is_deleted(spark):
    with scratch_scope(spark):
        df = written(spark.range(5), "thing")
        path = df.inputFiles()[0].rsplit("/", 1)[0]
        assert df.count() == 5 and exists(spark, path)
    assert not exists(spark, path)


def test_scopes_of_two_threads_are_apart(spark):
    started, deleted, seen = threading.Event(), threading.Event(), []

    def slow():
        with scratch_scope(spark):
            df = written(spark.range(7), "slow")
            started.set()
            deleted.wait(60)
            seen.append(df.count())
            seen.append(df.scratch)

    thread = threading.Thread(target=slow)
    thread.start()
    started.wait(60)
    with scratch_scope(spark):
        own = written(spark.range(5), "quick").scratch
    deleted.set()
    thread.join()
    assert seen[0] == 7 and not exists(spark, own) and not exists(spark, seen[1])


def test_empty_inner_scopes_and_errors_inside(spark):
    with scratch_scope(spark) as keep_outer:
        with scratch_scope(spark):
            pass
        with scratch_scope(spark) as keep:
            inner = keep(written(spark.range(3), "inner"))
        with pytest.raises(ZeroDivisionError), scratch_scope(spark):
            lost = written(spark.range(4), "lost").scratch
            raise ZeroDivisionError
        assert inner.count() == 3 and not exists(spark, lost)
        both = together(lambda: written(spark.range(1), "one"), lambda: written(spark.range(2), "two"))
        kept = keep_outer(both[0])
    assert exists(spark, kept.scratch) and not exists(spark, both[1].scratch) and not exists(spark, inner.scratch)


def test_two_runs_side_by_side(spark, tmp_path):
    root, store = str(tmp_path / "registry"), str(tmp_path / "store")
    for k in "ab":
        lines = ["n,t"] + [f"{i if i % 4 else ''},{'xy'[i % 2]}" for i in range(50)]
        (tmp_path / f"{k}.csv").write_text("\n".join(lines) + "\n")
        row = [(k, "fast", str(tmp_path / f"{k}.csv"), "uploaded")]
        registry.append(spark.createDataFrame(row, "id string, mode string, rawUrl string, status string"), "Dataset", root)
    results = together(*[lambda k=k: prepare_dataset(spark, root, k, store) for k in "ab"])
    assert [r.df.count() for r in results] == [50, 50]
    states = registry.latest(registry.read(spark, "Dataset", root)).select("id", "status").collect()
    assert sorted(tuple(r) for r in states) == [("a", "completed"), ("b", "completed")]


def test_stored_plans(spark, tmp_path):
    rows = [(i, "abc"[i % 3] if i % 7 else None, f"k{i % 40}", float(i % 9) if i % 4 else None, 1000.0 if i == 5 else float(i % 13)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, few string, many string, gap double, far double")
    plan = prepare(df, charts=False).plan
    assert plan.cleaning.steps and plan.outliers.steps and plan.features.labels and plan.features.one_hot
    loaded = load_plan(spark, save_plan(spark, plan, str(tmp_path / "plan")))
    assert sorted(map(str, loaded.apply(df).collect())) == sorted(map(str, plan.apply(df).collect()))
    assert loaded.outliers.steps == plan.outliers.steps and loaded.cleaning.log == plan.cleaning.log


def test_intake_runs_stages_that_collect(spark, tmp_path):
    arriving, path = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(f"k{i}", None if i % 4 == 0 else float(i), "ab"[i % 2]) for i in range(30)]
    spark.createDataFrame(rows, "k string, x double, t string").coalesce(1).write.parquet(arriving)
    schema = spark.read.parquet(arriving).schema

    def run(name):
        query = intake(file_stream(spark, arriving, schema), "k", lambda b: prepare(b, charts=False).df, path, str(tmp_path / name))
        query.awaitTermination()

    run("first")
    done = spark.read.parquet(f"{path}/batch=*")
    assert done.count() == 30 and done.filter("x IS NULL").count() == 0
    # the second delivery only looks at the ledger: output that is gone is not missed
    written_files = [f for f in done.inputFiles()]
    import os

    for f in written_files:
        os.truncate(f.replace("file://", ""), 0)
    run("again")
    assert sum(f.endswith("-again") for f in os.listdir(path)) == 0


def test_wide_correlation_is_one_scan(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(500, 300))
    data[:, 1] = data[:, 0] * 2 + 0.1 * data[:, 1]
    data[rng.random(data.shape) < 0.05] = np.nan
    data[:, 7] = 3.0
    frame = pd.DataFrame(data, columns=[f"c{i}" for i in range(300)])
    df = spark.createDataFrame(frame).repartition(3)
    from tableprep.functions.types import nan_to_null
    from tableprep.operators.profile import profile

    stats = profile(nan_to_null(df), quartiles=())
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("wide-correlation", "")
    got = correlation(df, stats).toPandas().pivot(index="x", columns="y", values="r")
    jobs = len(tracker.getJobIdsForGroup("wide-correlation"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 4
    expected = frame.corr()
    got = got.loc[expected.index, expected.columns].astype(float)
    assert np.allclose(got.to_numpy(), expected.to_numpy(), equal_nan=True, atol=1e-9)


def test_csv_files_are_split_where_they_can_be(spark, tmp_path):
    folder = tmp_path / "csvs"
    folder.mkdir()
    (folder / "plain.csv").write_text("a,b\n1,x\n2,y\n")
    (folder / "broken.csv").write_text('a,b\n3,"line\nbreak"\n4,"say ""hi"""\n')
    df = read_csv(spark, str(folder))
    assert sorted((r.a, r.b) for r in df.collect()) == [(1, "x"), (2, "y"), (3, "line\nbreak"), (4, 'say "hi"')]


def test_json_of_columns(spark, tmp_path):
    named, listed = tmp_path / "named.json", tmp_path / "listed.json"
    named.write_text('{"n": {"0": 1, "1": 2}, "when": {"0": "x", "1": null}, "date": {"0": "2024-01-02", "1": "2024-01-03"}}')
    listed.write_text('{"n": [1, 2, 3], "t": ["a", null, "c"]}')
    df = read_json(spark, str(named))
    assert df.dtypes == [("n", "bigint"), ("when", "string"), ("date", "timestamp_ntz")]
    assert sorted((r.n, r.when) for r in df.collect()) == [(1, "x"), (2, None)]
    assert sorted((r.n, r.t) for r in read_json(spark, str(listed)).collect()) == [(1, "a"), (2, None), (3, "c")]


def test_busy_user_is_cut_where_the_state_is_known(spark):
    # bursts over the limit a window and more apart, joined by requests that are never in doubt
    times = sorted([100 * b + k for b in range(40) for k in range(4)] + [100 * b + 50 for b in range(40)] + [100 * b + 90 for b in range(40)])
    rows = [(i, "u", (1_700_000_000 + t) * MICROS) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "id long, who string, us long").select("id", "who", F.timestamp_micros("us").alias("ts"))
    out = admission(df, "who", "ts", "id", 3, 60)
    admitted, state = [], []
    for t in times:
        state = [s for s in state if s > t - 60]
        admitted.append(len(state) < 3)
        if admitted[-1]:
            state.append(t)
    assert [r.admitted for r in out.orderBy("id").collect()] == admitted
    assert not all(admitted)
