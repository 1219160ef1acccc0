"""Decisions at their boundaries; no Spark job involved."""

from __future__ import annotations

import pytest

from tableprep.operators.profile import ColumnStats, Profile
from tableprep.plans import decide


def number(name="x", rows=100, nulls=10, low=0.0, high=10.0, q1=2.0, median=5.0, q3=8.0, mean=5.0, var=4.0, **more):
    return ColumnStats(
        name, "double", "number", False, rows, nulls, low, high, mean, var, q1, median, q3, more.get("distinct")
    )


def text(name="t", rows=100, nulls=10, distinct=5, mode="a"):
    return ColumnStats(name, "string", "string", False, rows, nulls, distinct=distinct, mode=mode)


def profile_of(*columns):
    return Profile(columns[0].rows, {c.name: c for c in columns})


def test_null_share_is_strict():
    assert decide.missing_strategy(number(nulls=80)).action == "mean"
    dropped = decide.missing_strategy(number(nulls=81))
    assert (dropped.action, dropped.reason) == ("drop_column", "Too many nulls (81.0%)")


def test_spread_is_strict():
    assert decide.missing_strategy(number(q1=2.0, q3=5.0)).action == "mean"  # exactly 0.3
    assert decide.missing_strategy(number(q1=2.0, q3=4.9)).action == "median"


def test_zero_variance_and_single_value():
    assert decide.missing_strategy(number(low=5.0, high=5.0)).reason == "Zero variance"
    assert decide.missing_strategy(number(rows=3, nulls=2)).reason == "Zero variance"


def test_cardinality_is_strict():
    assert decide.missing_strategy(text(distinct=50)).action == "mode"  # exactly 0.5 of all rows
    assert decide.missing_strategy(text(distinct=51)).action == "unknown"


def test_ranking_keeps_table_order_on_ties():
    stats = profile_of(number("a", nulls=5), number("b", nulls=9), number("c", nulls=5), number("d", nulls=0))
    assert [s.name for s in decide.null_ranking(stats)] == ["b", "a", "c"]


def test_advice_needs_more_than_the_share_and_stays_in_budget():
    stats = profile_of(*[number(n, nulls=k) for n, k in zip("abcdef", (50, 40, 30, 25, 20, 10))])
    assert [s.name for s in decide.advice_candidates(stats, "smart")] == ["a", "b", "c"]
    assert [s.name for s in decide.advice_candidates(stats, "deep")] == ["a", "b", "c"]
    assert decide.advice_candidates(stats, "fast") == []
    advice = {n: decide.Decision("unknown", "asked") for n in "bcdef"}
    chosen = {s.name: d.action for s, d in decide.choose_strategies(stats, "smart", advice)}
    # "a" has no answer and costs nothing; "e" sits exactly on the share.
    assert chosen == {"a": "mean", "b": "unknown", "c": "unknown", "d": "unknown", "e": "mean", "f": "mean"}
    assert {d.action for _, d in decide.choose_strategies(stats, "fast", advice)} == {"mean"}


@pytest.mark.parametrize(("distinct", "method"), [(10, "one-hot"), (11, "label")])
def test_encoding_threshold(distinct, method):
    found = decide.feature_suggestions(profile_of(text(nulls=0, distinct=distinct)))
    assert found.encoding[0]["method"] == method


def test_uncounted_text_is_labelled():
    assert decide.feature_suggestions(profile_of(text(distinct=None))).encoding[0]["method"] == "label"


def test_scaling_needs_variation_above_one():
    flat = number("a", rows=101, nulls=0, mean=2.0, var=4.0 * 100 / 101)  # std 2, variation exactly 1
    wide = number("b", rows=101, nulls=0, mean=1.9, var=4.0 * 100 / 101)
    centred = number("c", rows=101, nulls=0, low=-1.0, mean=0.0)
    assert [s["column"] for s in decide.feature_suggestions(profile_of(flat, wide, centred)).scaling] == ["b"]


def test_drop_suggestions():
    stats = profile_of(
        number("id", nulls=0, distinct=100), number("one", nulls=0, low=1.0, high=1.0), number("gap", distinct=90)
    )
    assert [(d["column"], d["reason"]) for d in decide.feature_suggestions(stats).drop] == [
        ("id", "Unique identifier"),
        ("one", "Constant column"),
    ]


def test_useful_categories():
    stats = profile_of(*[text(f"t{n}", nulls=0, distinct=n) for n in (1, 2, 50, 51, 3, 4, 5, 6)])
    assert [s.name for s in decide.useful_categories(stats)] == ["t2", "t50", "t3", "t4", "t5"]


def test_top_variance_unknown_last_ties_in_table_order():
    stats = profile_of(number("a", rows=1, nulls=0), number("b", var=1.0), number("c", var=9.0), number("d", var=1.0))
    assert [s.name for s in decide.top_variance(stats)] == ["c", "b", "d", "a"]


def test_feature_roles():
    assert decide.feature_roles(["a", "Target_1", "key"]) == [("a", "input"), ("Target_1", "output"), ("key", "output")]
    assert decide.feature_roles(["a", "b"]) == [("a", "input"), ("b", "output")]
    assert decide.feature_roles([]) == []


def test_feature_advice_gate():
    assert decide.wants_feature_advice(5, True)
    assert not decide.wants_feature_advice(4, True)
    assert not decide.wants_feature_advice(10, False)
    assert decide.wants_feature_advice(11, False)
