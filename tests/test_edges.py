"""Small tables with known answers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprep import (
    clean,
    encode_labels,
    encode_one_hot,
    engineer,
    fill,
    plan_features,
    prepare,
    profile,
    scale,
    treat_column,
    treat_outliers,
)
from tableprep.functions.exprs import cut, histogram_bin
from tableprep.functions.types import col, nan_to_null
from tableprep.operators import eda as charts


def values(df, name):
    return [r[0] for r in df.select(col(name)).collect()]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    s = profile(nan_to_null(df))["x"]
    assert (s.nulls, s.low, s.high, s.mean, s.median) == (2, 1.0, 3.0, 2.0, 2.0)
    assert sorted(values(fill(df, "x", "mean"), "x")) == [1.0, 2.0, 2.0, 3.0]


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double, t string")
    cleaned, log = clean(df)
    assert cleaned.columns == ["x", "t"] and log.count() == 0
    treated, log = treat_outliers(df)
    assert treated.count() == 0 and log.count() == 0
    result = prepare(df)
    assert result.rows == 0 and result.df.count() == 0


def test_one_row(spark):
    df = spark.createDataFrame([(1, 2.0, "a")], "i int, x double, t string")
    s = profile(df, distinct=None)
    assert (s["x"].std, s["x"].q1, s["x"].q3, s["i"].distinct) == (None, 2.0, 2.0, 1)
    result = prepare(df)
    assert result.df.collect()[0].asDict() == {"i": 1, "x": 2.0, "t_a": True}


def test_all_null_columns(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, None)], "i int, x double, t string")
    cleaned, log = clean(df)
    assert cleaned.columns == ["i"]
    assert [r.reason for r in log.collect()] == ["Too many nulls (100.0%)"] * 2


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("a",), ("b",), ("c",)], "t string")
    cleaned, log = clean(df)
    assert sorted(values(cleaned, "t")) == ["a", "a", "a", "b", "b", "c"]
    assert log.first().action == "Filled with mode (a)"


def test_mean_of_integers_rounds_half_to_even(spark):
    df = spark.createDataFrame([(2,), (3,), (None,)], "i int")
    assert sorted(values(fill(df, "i", "mean"), "i")) == [2, 2, 3]
    df = spark.createDataFrame([(3,), (4,), (None,)], "i int")
    assert sorted(values(fill(df, "i", "mean"), "i")) == [3, 4, 4]


def test_odd_names(spark):
    df = spark.createDataFrame([(1.0, "x.y"), (None, "z"), (3.0, None), (2.0, "x.y")], "`a.b` double, `c d` string")
    result = prepare(df)
    assert result.df.columns == ["a.b", "c d_x.y", "c d_z"]
    assert sorted(values(result.df, "a.b")) == [1.0, 2.0, 2.0, 3.0]
    assert sum(values(result.df, "c d_x.y")) == 3


def test_booleans_and_dates_are_categories(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (true, DATE'2024-01-02'), (true, DATE'2024-01-02'), (false, NULL), (NULL, DATE'2024-01-01') "
        "AS t(flag, day)"
    )
    cleaned, log = clean(df)
    assert values(cleaned, "flag").count(True) == 3
    assert dict(cleaned.dtypes) == {"flag": "boolean", "day": "date"}
    assert {r.column: r.action for r in log.collect()} == {
        "flag": "Filled with mode (True)",
        "day": "Filled with mode (2024-01-02)",
    }
    unknown = fill(df, "day", "unknown")
    assert dict(unknown.dtypes)["day"] == "string" and "Unknown" in values(unknown, "day")


def test_nested_columns_pass_through(spark):
    df = spark.sql("SELECT 1 AS i, array(1, 2) AS a UNION ALL SELECT 2, NULL")
    cleaned, log = clean(df)
    assert dict(cleaned.dtypes)["a"] == "array<int>"
    assert log.first().action == "Left unchanged"
    assert prepare(df).df.columns == ["i", "a"]


def test_unusable_advice_becomes_the_default(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "t string")
    advice = spark.createDataFrame([("t", "mean", "odd")], "column string, action string, reason string")
    cleaned, log = clean(df, "smart", advice)
    assert values(cleaned, "t") == ["a", "a", "a"]
    assert log.first().reason == "Default strategy for categorical column"


def test_forward_fill_needs_an_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "i int, t string")
    advice = spark.createDataFrame([("t", "forward_fill", "r")], "column string, action string, reason string")
    with pytest.raises(ValueError, match="order_by"):
        clean(df, "smart", advice)
    cleaned, log = clean(df, "smart", advice, order_by=["i"])
    assert sorted((r.i, r.t) for r in cleaned.collect()) == [(1, "a"), (2, "a"), (3, "b")]
    assert log.first().action == "Forward filled"


def test_share_of_exactly_a_tenth_is_treated(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 8, 9, 100]], "x double")
    treated, log = treat_outliers(df)
    assert max(values(treated, "x")) == 14.5
    assert log.first().asDict() == {
        "seq": 0,
        "column": "x",
        "outlier_count": 1,
        "method": "IQR",
        "action": "Capped to upper/lower bound",
    }
    _, log = treat_outliers(df, max_share=0.09)
    assert log.first().action == "Skipped (outlier percentage 10.0% > 9.0%)"


def test_nulls_survive_treatment(spark):
    df = spark.createDataFrame([(float(v),) for v in range(20)] + [(1000.0,), (None,)], "x double")
    for strategy in ("cap", "replace_median", "remove"):
        out = values(treat_column(df, "x", strategy), "x")
        assert out.count(None) == 1 and max(v for v in out if v is not None) < 1000


def test_unknown_method_or_strategy_changes_nothing(spark):
    df = spark.createDataFrame([(float(v),) for v in range(20)] + [(1000.0,)], "x double")
    for options in ({"method": "LOF"}, {"strategy": "drop"}):
        treated, log = treat_outliers(df, **options)
        assert max(values(treated, "x")) == 1000.0 and log.count() == 0


def test_integer_bounds_stay_in_type(spark):
    df = spark.createDataFrame([(v,) for v in [0, 1, 2, 2**31 - 1, -(2**31)]], "i int")
    assert sorted(values(treat_column(df, "i", "cap"), "i")) == [-3, 0, 1, 2, 5]


def test_one_hot(spark):
    df = spark.createDataFrame([(1, True, 2.0), (2, None, 1.0), (3, False, None)], "i int, f boolean, x double")
    assert encode_one_hot(df, "f").columns == ["i", "x", "f_False", "f_True"]
    hot = encode_one_hot(df, "x")
    assert hot.columns == ["i", "f", "x_1.0", "x_2.0"]
    assert [(r["x_1.0"], r["x_2.0"]) for r in hot.orderBy("i").collect()] == [(False, True), (True, False), (False, False)]
    with pytest.raises(ValueError, match="more than"):
        encode_one_hot(spark.range(51).withColumn("t", F.col("id").cast("string")), "t", most=50)
    assert len(encode_one_hot(spark.range(2100).withColumn("t", F.col("id").cast("string")), "t").columns) == 2101


def test_labels_count_missing_as_text(spark):
    df = spark.createDataFrame([("b",), (None,), ("z",), ("é",)], "t string")
    assert sorted(values(encode_labels(df, "t"), "t")) == [0, 1, 2, 3]


def test_scaling_of_constants(spark):
    df = spark.createDataFrame([(3, 1.0), (3, 2.0)], "i int, x double")
    assert values(scale(df, "i", "standard"), "i") == [0.0, 0.0]
    assert values(scale(df, "i", "min-max"), "i") == [0.0, 0.0]
    assert sorted(values(scale(df, "x", "standard"), "x")) == [-1.0, 1.0]


def test_cut_is_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 18, 19, 35, 50, 100, 101)], "i int")
    out = values(df.select(cut(F.col("i"), [0, 18, 35, 50, 100], list("abcd")).alias("c")), "c")
    assert out == [None, "a", "a", "b", "b", "c", "d", None]


def test_feature_plan_order_and_logs(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], float(i % 3), i * 10, "k") for i in range(6)], "i int, t string, x double, Age int, c string")
    advice = {
        "encoding": [{"column": "t", "method": "label"}, {"column": "c", "method": "hash"}, {"column": "gone"}],
        "scaling": [{"column": "t", "method": "min-max", "reason": "codes"}, {"column": "x", "method": "log"}],
        "drop": ["c", {"column": "i", "reason": "key"}],
        "new_features": [{"name": "AgeGroup", "description": ""}, {"name": "Sum", "description": "total"}],
    }
    out, log = engineer(df, advice=advice, scaling=True, dropping=True)
    assert out.columns == ["t", "x", "Age", "AgeGroup"]
    assert sorted(set(values(out, "t"))) == [0.0, 1.0]
    assert values(out.orderBy("Age"), "AgeGroup") == [None, "Young", "Adult", "Adult", "Middle", "Middle"]
    assert [(r.action, r.details) for r in log.orderBy("seq").collect()] == [
        ("Encoded 't' (label)", "Categorical encoding needed"),
        ("Scaled 't' (min-max)", "codes"),
        ("Dropped 'c'", "Low importance"),
        ("Dropped 'i'", "key"),
        ("Created 'AgeGroup'", ""),
        ("Suggested: create 'Sum'", "total"),
    ]


def test_disabled_steps_are_only_suggested(spark):
    df = spark.createDataFrame([(i, "k", float(10**i)) for i in range(6)], "i int, t string, x double")
    plan = plan_features(df, encoding=False)
    assert plan.log == [
        ("Suggested: encode 't' (one-hot)", "Low cardinality"),
        ("Suggested: scale 'x' (standard)", "High variance"),
        ("Suggested: drop 'i'", "Unique identifier"),
        ("Suggested: drop 't'", "Constant column"),
        ("Suggested: drop 'x'", "Unique identifier"),
    ]
    assert plan.apply(df).columns == df.columns


def test_histogram_of_a_constant_and_edges(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "x double")
    out = {r.bin: r.n for r in charts.histogram(df, list(profile(df))).collect()}
    assert len(out) == 30 and out[15] == 2 and sum(out.values()) == 2
    # Next to an edge the quotient alone would land one bin off; NumPy settles it the same way.
    numbers = [v / 10 for v in range(11)] + [v / 7 for v in range(8)]
    df = spark.createDataFrame([(v,) for v in numbers], "x double")
    bins = values(df.select(histogram_bin(F.col("x"), 0.0, 1.0, 10).alias("b")), "b")
    assert [bins.count(b) for b in range(10)] == np.histogram(numbers, 10, (0.0, 1.0))[0].tolist()


def test_correlation_edges(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0), (2.0, 4.0, 7.0), (3.0, None, 7.0), (4.0, 7.0, 7.0)], "a double, b double, k double")
    r = {(x.x, x.y): x.r for x in charts.correlation(df).collect()}
    assert r["a", "a"] == 1.0 and r["k", "k"] is None and r["a", "k"] is None
    assert math.isclose(r["a", "b"], 0.9972, abs_tol=1e-3) and r["a", "b"] == r["b", "a"]
    assert charts.correlation(df.select("a")) is None
    twins = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (5.0, None)], "a double, b double")
    assert math.isclose({(x.x, x.y): x.r for x in charts.correlation(twins).collect()}["a", "b"], 1.0)


def test_whiskers_reach_back_to_the_box(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 1, 1, 1, 100, 100, 100, 1000)], "x double")
    row = charts.boxplot(df, list(profile(df))).first()
    assert (row.whisker_low, row.q1, row.q3, row.whisker_high, row.fliers) == (1.0, 1.0, 100.0, 100.0, 1)
