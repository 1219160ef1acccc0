"""Saving and loading a fitted preparation, so that another application can apply it."""

from __future__ import annotations

import json
from dataclasses import asdict
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from tableprep.operators.clean import CleaningPlan, FillStep
from tableprep.operators.features import Bucket, FeaturePlan, LabelCodes, OneHot, Scale
from tableprep.operators.outliers import OutlierPlan, OutlierStep
from tableprep.operators.profile import ColumnStats
from tableprep.plans.prepare import PreparationPlan

SCHEMA = "stage string, position int, column string, op string, argument string"
STEPS = {"one_hot": OneHot, "scales": Scale, "buckets": Bucket}


def _text(value) -> str:
    return json.dumps(value, default=lambda v: {"__decimal": str(v)} if isinstance(v, Decimal) else str(v))


def _value(text: str):
    return json.loads(text, object_hook=lambda d: Decimal(d["__decimal"]) if "__decimal" in d else d)


def plan_rows(plan: PreparationPlan) -> list[tuple]:
    """``(stage, position, column, op, argument)``: every step of the plan, its parameters as JSON."""
    rows = [("cleaning", i, s.column, s.kind, _text(asdict(s))) for i, s in enumerate(plan.cleaning.steps)]
    cleaning = {k: getattr(plan.cleaning, k) for k in ("order_by", "keys", "rows_per_range")}
    rows.append(("cleaning", -1, None, "options", _text(cleaning)))
    rows += [("outliers", i, s.column, s.strategy, _text(asdict(s))) for i, s in enumerate(plan.outliers.steps)]
    for op in STEPS:
        steps = getattr(plan.features, op)
        rows += [("features", i, getattr(s, "column", None), op, _text(asdict(s))) for i, s in enumerate(steps)]
    for i, s in enumerate(plan.features.labels):
        rows.append(("features", i, s.column, "labels", _text({"small": s.small, "hot": s.hot})))
    rows += [("features", i, c, "drops", None) for i, c in enumerate(plan.features.drops)]
    for stage in ("cleaning", "outliers", "features"):
        rows += [(stage, i, None, "log", _text(list(r))) for i, r in enumerate(getattr(plan, stage).log)]
    return rows


def save_plan(spark: SparkSession, plan: PreparationPlan, path: str) -> str:
    """Write the steps as one small table and each label dictionary beside it."""
    spark.createDataFrame(plan_rows(plan), SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/steps")
    for i, step in enumerate(plan.features.labels):
        step.dictionary.write.mode("overwrite").parquet(f"{path}/dictionaries/{i}")
    return path


def load_plan(spark: SparkSession, path: str) -> PreparationPlan:
    """The plan that ``save_plan`` wrote; its dictionaries are read from there when it is applied."""
    steps: DataFrame = spark.read.schema(SCHEMA).parquet(f"{path}/steps")
    found: dict[tuple[str, str], list] = {}
    for r in sorted(steps.collect(), key=lambda r: r["position"]):
        found.setdefault((r["stage"], r["op"]), []).append(r)
    of = lambda stage, op: found.get((stage, op), [])
    logs = {stage: [tuple(_value(r["argument"])) for r in of(stage, "log")] for stage in ("cleaning", "outliers", "features")}
    named = [r for (stage, op), rows in found.items() if stage == "cleaning" and op not in ("options", "log") for r in rows]
    fills = [FillStep(**_value(r["argument"])) for r in sorted(named, key=lambda r: r["position"])]
    cleaning = CleaningPlan(fills, logs["cleaning"], **_value(of("cleaning", "options")[0]["argument"]))
    treated = [r for (stage, op), rows in found.items() if stage == "outliers" and op != "log" for r in rows]
    outliers = OutlierPlan([_outlier_step(r["argument"]) for r in sorted(treated, key=lambda r: r["position"])], logs["outliers"])
    features = FeaturePlan(drops=[r["column"] for r in of("features", "drops")], log=logs["features"])
    for op, kind in STEPS.items():
        setattr(features, op, [kind(**_value(r["argument"])) for r in of("features", op)])
    for i, r in enumerate(of("features", "labels")):
        dictionary = spark.read.schema("label string, code bigint").parquet(f"{path}/dictionaries/{i}")
        features.labels.append(LabelCodes(r["column"], dictionary, **_value(r["argument"])))
    return PreparationPlan(cleaning, outliers, features)


def _outlier_step(text: str) -> OutlierStep:
    given = _value(text)
    return OutlierStep(**{**given, "stats": ColumnStats(**given["stats"])})
