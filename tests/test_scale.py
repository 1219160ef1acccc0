"""The routes for large and skewed tables, forced on small ones and checked against brute force."""

from __future__ import annotations

from collections import deque

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tableprep import admission, audit, encode_labels, forward_fill, profile
from tableprep.operators import frequencies, quantiles
from tableprep.operators import profile as profiling
from tableprep.operators.ordered import RANGE, numbered, running, with_ranges
from tableprep.sources import registry


@pytest.fixture(scope="module")
def skewed(spark):
    """One user has a third of all rows, one instant is shared by a third, values have gaps and ties."""
    rng = np.random.default_rng(5)
    n = 3000
    frame = pd.DataFrame(
        {
            "id": np.arange(n),
            "user": np.where(rng.random(n) < 0.34, 1, rng.integers(2, 60, n)),
            "t": np.where(rng.random(n) < 0.34, 777_000_000, rng.integers(0, 2_000, n) * 1_000_000),
            "v": np.where(rng.random(n) < 0.4, np.nan, np.round(rng.gamma(2.0, 50.0, n), 1)),
        }
    )
    schema = "id bigint, user bigint, t bigint, v double"
    df = spark.createDataFrame([tuple(r) for r in frame.itertuples(index=False)], schema)
    return frame, df.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


@pytest.mark.parametrize("limit", [10, 60, 400])
@pytest.mark.parametrize("accuracy", [20, 200])
def test_quantiles_narrow_to_the_exact_value(spark, skewed, limit, accuracy, monkeypatch):
    frame, df = skewed
    monkeypatch.setattr(quantiles, "COLLECT_LIMIT", limit)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    for c in ("v", "t", "user"):
        x = frame[c].dropna()
        sketched = df.agg(quantiles.sketch(F.col(c).cast("double"), probs, accuracy).alias("q")).first()["q"]
        targets = quantiles.make_targets(c, probs, len(x), float(x.min()), float(x.max()), sketched, accuracy)
        quantiles.solve(df, targets, accuracy, limit)
        assert [t.value for t in targets] == pytest.approx([x.quantile(p) for p in probs], rel=1e-12)


def test_a_wrong_bracket_is_noticed(spark, skewed):
    frame, df = skewed
    x = frame["v"].dropna()
    targets = quantiles.make_targets("v", [0.5], len(x), x.min(), x.max(), None)
    targets[0].lo, targets[0].hi, targets[0].inner = 0.0, 1.0, 3
    quantiles.solve(df, targets)
    assert targets[0].value == pytest.approx(x.median())


def test_ranges_follow_the_order(skewed):
    frame, df = skewed
    placed = with_ranges(df, ["user", "t", "id"], 100)
    ranges = [r[RANGE] for r in placed.orderBy("user", "t", "id").collect()]
    assert ranges == sorted(ranges)
    sizes = pd.Series(ranges).value_counts()
    assert sizes.max() == 100 and len(sizes) >= len(frame) // 100
    assert RANGE not in with_ranges(df, ["user", "t", "id"], len(frame)).columns


@pytest.mark.parametrize("rows_per_range", [10**9, 200, 37])
@pytest.mark.parametrize("keys", [[], ["user"]])
def test_running_values(skewed, keys, rows_per_range):
    frame, df = skewed
    out = running(
        df,
        keys,
        ["t", "id"],
        sums={"total": F.lit(1)},
        lasts={"last": F.col("v")},
        previous={"before": F.col("v")},
        nexts={"next": F.col("v")},
        rows_per_range=rows_per_range,
    ).toPandas()
    out = out.sort_values("id").reset_index(drop=True)
    ordered = frame.sort_values(["t", "id"])
    groups = ordered.groupby(keys or [0] * len(ordered))
    expected = pd.DataFrame(
        {
            "total": groups.cumcount() + 1,
            "last": groups["v"].ffill(),
            "before": groups["v"].transform(lambda s: s.ffill().shift()),
            "next": groups["v"].bfill(),
        }
    ).sort_index()
    for c in expected.columns:
        pd.testing.assert_series_equal(out[c], expected[c], check_dtype=False, check_names=False)


def test_numbers_follow_the_order(skewed):
    frame, df = skewed
    out = numbered(df, ["user", "t", "id"], "n").toPandas().sort_values(["user", "t", "id"])
    assert out["n"].tolist() == list(range(len(frame)))


def test_running_keeps_null_keys_and_orders(spark):
    rows = [(i, None if i % 3 == 0 else "a", None if i % 5 == 0 else i, i if i % 4 == 0 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, k string, o int, v int")
    whole, cut = (
        running(df, ["k"], ["o", "id"], sums={"n": F.lit(1)}, lasts={"l": F.col("v")}, rows_per_range=r)
        for r in (10**9, 23)
    )
    assert whole.exceptAll(cut).isEmpty()
    assert cut.count() == 400


def test_ranges_over_every_type(spark):
    df = spark.range(500).selectExpr(
        "id",
        "IF(id % 9 = 0, NULL, id / 7.0D) AS x",
        "CAST(id / 10 AS DECIMAL(8,1)) AS d",
        "concat('k \"', id % 37) AS t",
        "TIMESTAMP_NTZ'2024-01-01 00:00:00.123456' + make_dt_interval(0, 0, 0, (id % 50) * 0.000001) AS n",
        "timestamp_seconds(id * 0.25) AS s",
        "date_add(DATE'2024-01-01', CAST(id % 11 AS INT)) AS y",
        "id % 2 = 0 AS b",
    )
    for by in ("x", "d", "t", "n", "s", "y", "b"):
        out = running(df, [], [by, "id"], sums={"place": F.lit(1)}, rows_per_range=20).orderBy(by, "id").collect()
        assert [r.place for r in out] == list(range(1, 501)), by


def test_keyless_forward_fill(skewed):
    frame, df = skewed
    out = forward_fill(df, ["v"], ["t", "id"], rows_per_range=50).toPandas().set_index("id")["v"]
    ordered = frame.sort_values(["t", "id"]).set_index("id")["v"].ffill()
    pd.testing.assert_series_equal(out.sort_index(), ordered.sort_index(), check_dtype=False, check_names=False)


def _brute_prior(frame, width):
    prior = {}
    for _, g in frame.sort_values(["t", "id"]).groupby("user"):
        times = g.t.tolist()
        for i, (now, key) in enumerate(zip(times, g.id)):
            prior[key] = sum(now - width < t for t in times[:i])
    return prior


def _brute_admission(frame, limit, width):
    out = {}
    for _, g in frame.sort_values(["t", "id"]).groupby("user"):
        times: deque = deque()
        for now, key in zip(g.t, g.id):
            while times and times[0] <= now - width:
                times.popleft()
            out[key] = len(times) < limit
            if out[key]:
                times.append(now)
    return out


@pytest.mark.parametrize("rows_per_range", [10**9, 150])
def test_rate_audit(skewed, rows_per_range):
    frame, df = skewed
    out = audit(df, "user", "t", "id", 4, 30, rows_per_range=rows_per_range).toPandas().set_index("id")
    prior = _brute_prior(frame, 30_000_000)
    assert out["prior"].to_dict() == prior
    assert (out["denied"] == (out["prior"] >= 4)).all()
    assert out["remaining"].notna().equals(~out["denied"]) and out["retry_after"].notna().equals(out["denied"])
    assert (out.loc[out["denied"], "retry_after"].between(1, 31)).all()


@pytest.mark.parametrize("rows_per_range", [10**9, 150])
@pytest.mark.parametrize(("limit", "seconds"), [(4, 30), (1, 5), (2, 400)])
def test_admission(skewed, limit, seconds, rows_per_range):
    frame, df = skewed
    out = admission(df, "user", "t", "id", limit, seconds, rows_per_range=rows_per_range)
    assert out.columns == ["id", "user", "t", "v", "admitted"]
    got = {r.id: r.admitted for r in out.collect()}
    assert got == _brute_admission(frame, limit, seconds * 1_000_000)


def test_quota_of_a_hot_user(spark, skewed):
    frame, df = skewed
    usage = df.select(F.col("user").alias("userId"), F.lit("smart").alias("mode"), F.col("t").alias("createdAt"), "id")
    out = registry.quota_admission(usage, rows_per_range=100).toPandas().set_index("id")
    expected = frame.sort_values(["t", "id"]).groupby("user").cumcount() + 1
    expected.index = frame.loc[expected.index, "id"]
    assert out["use_number"].to_dict() == expected.to_dict()
    assert (out["admitted"] == (out["use_number"] <= 3)).all()


def test_large_dictionary(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"v{i % 200:03d}" + "x" * (i % 90) if i % 7 else None) for i in range(1500)]
    df = spark.createDataFrame(rows, "id int, t string")
    small = encode_labels(df, "t").orderBy("id").collect()
    large = encode_labels(df, "t", small=0)
    assert large.orderBy("id").collect() == small
    texts = sorted({"nan" if t is None else t for _, t in rows})
    assert [r.t for r in small] == [texts.index("nan" if t is None else t) for _, t in rows]


def test_screening_never_changes_a_decision(spark, small, monkeypatch):
    monkeypatch.setattr(profiling, "SLICE_ROWS", 100)
    monkeypatch.setattr(profiling, "SMALL_DISTINCT", 20)
    for name in ("lineitem", "documents", "events", "orders"):
        df = spark.read.parquet(f"{small}/{name}.parquet")
        whole, screened = profile(df, quartiles=(), distinct=None), profile(df, quartiles=(), distinct=None, screen=True)
        for a, b in zip(whole, screened):
            assert (a.unique, a.constant) == (b.unique, b.constant)
            if a.kind == "string":
                assert a.at_most(10) == b.at_most(10)
    assert screened["o_orderkey"].distinct == screened.rows and screened["o_custkey"].distinct is None


def test_wide_tables_have_the_same_statistics(spark, skewed):
    _, df = skewed
    more = [F.when(F.col("id") % (i + 2) != 0, F.col("user") + i).alias(f"i{i}") for i in range(12)]
    more += [(F.col("v") * (i + 1)).alias(f"x{i}") for i in range(12)]
    big = (F.lit(9007199254740993) + F.col("id")).alias("big")
    wide = df.select("id", F.lit("t").alias("t"), F.lit(None).cast("int").alias("none"), big, *more)
    whole = profile(wide, quartiles=())
    for name in wide.columns:
        alone = profile(wide, [name], quartiles=())[name]
        assert (whole[name].rows, whole[name].nulls) == (alone.rows, alone.nulls)
        assert (whole[name].low, whole[name].high) == (alone.low, alone.high)
        assert whole[name].mean == pytest.approx(alone.mean) and whole[name].std == pytest.approx(alone.std)
    assert whole["big"].low == 9007199254740993


def test_long_texts_are_counted_by_digest(spark):
    base = "long text " * 20
    df = spark.createDataFrame([(base + str(i % 7),) for i in range(50)] + [("a",), ("a",), (None,)], "t string")
    assert frequencies.distinct_counts(df, ["t"]) == {"t": 8}


def test_number_of_jobs_does_not_grow_with_columns(spark):
    def jobs(columns: int) -> int:
        df = spark.range(500).select(*[(F.col("id") * (i + 1)).alias(f"c{i}") for i in range(columns)])
        before = _job_count(spark)
        profile(df, distinct=None)
        return _job_count(spark) - before

    assert jobs(60) <= jobs(15) + 3


def _job_count(spark) -> int:
    """Jobs submitted so far; the status tracker forgets early ones."""
    return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()


def adversarial(kind: str) -> list[float]:
    rng = np.random.default_rng(3)
    tiny = [np.nextafter(1.0, 2.0) + i * 2.0**-52 for i in range(3000)]
    return {
        "neighbours": [float(x) for x in tiny] * 2,
        "all sizes": [float(s * 10.0**e) for e in range(-320, 309) for s in (-1.0, -3.3, 1.0, 7.7)],
        "least": [float(i * 5e-324) for i in range(-1500, 1500)],
        "bits": [x for x in rng.integers(-(2**62), 2**62, 5000).view(np.float64).tolist() if x == x and abs(x) < math.inf],
        "hot": [0.0] * 4000 + [-0.0] * 500 + [1e-300 * i for i in range(1000)] + [1e300],
        "ends": [-math.inf, math.inf] + [float(i) for i in range(100)],
    }[kind]


@pytest.mark.parametrize("bins", [3, 64, quantiles.BINS])
@pytest.mark.parametrize("kind", ["neighbours", "all sizes", "least", "bits", "hot"])
def test_quantiles_end_on_adversarial_values(spark, kind, bins):
    values = adversarial(kind)
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    ordered = sorted(values)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    targets = quantiles.make_targets("v", probs, len(values), ordered[0], ordered[-1], None)
    passes = []
    original = quantiles._bin_counts
    with pytest.MonkeyPatch.context() as patched:
        patched.setattr(quantiles, "_bin_counts", lambda *a: passes.append(1) or original(*a))
        patched.setattr(quantiles, "SMALL_TABLE_ROWS", 0)
        quantiles.solve(df, targets, limit=bins)
    for t in targets:
        low, high = ordered[t.ranks[0]], ordered[t.ranks[1]]
        assert t.value == quantiles._interpolate(low, high, t.position)
    assert len(passes) <= {3: 64, 64: 12, quantiles.BINS: 7}[bins]


def test_order_keys_are_the_bits(spark):
    values = [v for k in ("neighbours", "all sizes", "least", "bits", "ends") for v in adversarial(k)] + [2.0**e for e in range(-1074, 1024)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", quantiles.order_keys(F.col("v")).alias("k")).collect()
    assert all(r.k == quantiles.order_key(r.v) for r in rows)
    assert [r.k for r in sorted(rows)] == sorted(r.k for r in rows)


def test_values_outside_of_the_range_are_noticed(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "v double")
    with pytest.raises(RuntimeError, match="NaN"):
        quantiles.solve(df, quantiles.make_targets("v", [0.9], 3, 1.0, 2.0, None))


def removed_in_order(frame: pd.DataFrame, max_share: float) -> tuple[list[tuple], list[int]]:
    """Column after column: fences of the rows left, and what lies outside removed."""
    log = []
    names = [c for c in frame.columns if c != "id" and frame[c].nunique() > 1]
    for c in ["id", *names]:
        q1, q3 = frame[c].quantile(0.25), frame[c].quantile(0.75)
        far = (frame[c] < q1 - 1.5 * (q3 - q1)) | (frame[c] > q3 + 1.5 * (q3 - q1))
        if far.sum():
            log.append((c, int(far.sum()), bool(far.sum() / len(frame) <= max_share)))
            frame = frame[~far] if log[-1][2] else frame
    return log, sorted(frame["id"])


@pytest.mark.parametrize("kind", ["apart", "together", "few values"])
def test_removal_reads_the_table_a_fixed_number_of_times(spark, kind, monkeypatch):
    from tableprep.operators import outliers

    rng = np.random.default_rng(8)
    n = 4000
    frame = pd.DataFrame({"id": np.arange(n)})
    hidden = rng.standard_t(2, n)
    for k in range(6):
        if kind == "apart":
            frame[f"c{k}"] = np.round(rng.standard_t(3, n), 3)
        elif kind == "together":  # whoever is far in one column is so in the next: quartiles and fences move
            frame[f"c{k}"] = np.round(hidden * (k + 1) + rng.normal(size=n) * 0.3, 3)
        else:
            frame[f"c{k}"] = rng.choice([1.0, 2.0, 3.0, 4.0, 30.0], n, p=[0.3, 0.3, 0.2, 0.15, 0.05])
        frame.loc[rng.random(n) < 0.1, f"c{k}"] = np.nan
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "id long, " + ", ".join(f"c{k} double" for k in range(6))).repartition(3)
    calls = []
    original = outliers.profile
    monkeypatch.setattr(outliers, "profile", lambda *a, **o: calls.append(1) or original(*a, **o))
    assert removed_in_order(frame, 0.3)[0] == [row[:2] + (row[3] == "Removed rows",) for row in outliers.plan_outliers(df, strategy="remove", max_share=0.3).log]
    assert len(calls) > 4  # a small table is profiled for every removal
    calls.clear()
    monkeypatch.setattr(outliers, "SMALL_ROWS", 0)
    plan = outliers.plan_outliers(df, strategy="remove", max_share=0.3)
    log, kept = removed_in_order(frame, 0.3)
    assert [(c, count, action == "Removed rows") for c, count, _, action in plan.log] == log
    assert sorted(r.id for r in plan.apply(df).select("id").collect()) == kept
    assert len(plan.steps) >= 4
    if kind == "apart":
        assert len(calls) == 2  # constants, and the first quartiles


@pytest.fixture
def many_documents(spark, tmp_path):
    """A folder of tables whose documents lie in five files, read in as many splits."""
    rows = [(i, f'text {i} "q"\n{"x" * 200}', "en", f"s{i % 3}", 200 + i) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in kept:
        spark.conf.set(k, "4000")
    yield str(tmp_path), rows
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name, reader", [("read_csv_quoted_file", "read_csv"), ("read_json_array", "read_json")])
def test_no_task_writes_all_documents_to_one_file(spark, many_documents, monkeypatch, name, reader):
    from entries import records

    folder, rows = many_documents
    files = []
    read = getattr(records, reader)
    monkeypatch.setattr(records, "FILE_BYTES", 10_000, raising=False)
    monkeypatch.setattr(records, reader, lambda s, path: files.extend(s.read.text(path).inputFiles()) or read(s, path))
    found = getattr(records, name)(spark, folder).collect()
    assert len(files) > 1
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in found) == [(r[0], r[1], r[4]) for r in rows]


def test_files_of_columns_are_put_together_in_parts_of_bounded_size(spark, tmp_path, monkeypatch):
    import json

    from tableprep.sources import tables

    for k in range(3):
        cells = {"a": {str(i): 100 * k + i for i in range(50)}, "b": {str(i): f"t{k}-{i}" for i in range(50)}}
        (tmp_path / f"{k}.json").write_text(json.dumps(cells))
    monkeypatch.setattr(tables, "CELL_BYTES", 100, raising=False)
    read = tables.read_json(spark, str(tmp_path))
    assert sorted((r["a"], r["b"]) for r in read.collect()) == [(100 * k + i, f"t{k}-{i}") for k in range(3) for i in range(50)]
    size = sum(f.stat().st_size for f in tmp_path.glob("*.json"))
    assert read.rdd.getNumPartitions() >= size // 100


@pytest.mark.parametrize("most", [0, 100])
def test_rows_of_wanted_keys_are_not_sorted(spark, monkeypatch, most):
    monkeypatch.setattr(registry, "BROADCAST_KEYS", most, raising=False)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        logs = spark.createDataFrame([("1", 1), ("2", 2), ("2", 3), (None, 4), ("4", 5)], "datasetId string, n int")
        wanted = spark.createDataFrame([("2",), ("2",), (None,), ("4",), ("9",)], "id string")
        found = registry.get_all(logs, wanted, "datasetId")
        assert sorted(r["n"] for r in found.collect()) == [2, 3, 5]
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
