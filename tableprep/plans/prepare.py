"""The whole preparation: clean, chart, treat outliers, engineer features, report, register.

Every stage decides from a profile and then only adds a projection of literals to the plan, so the
source is read again for the next profile instead of being kept: column-pruned scans of Parquet cost
less than caching a large table.  Only a forward fill, which shuffles, is written out in between.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.functions.types import nan_to_null
from tableprep.operators.advice import fallback_report, is_quota_error, parse_report
from tableprep.operators.clean import CleaningPlan, plan_cleaning, profile_missing
from tableprep.operators.eda import EdaResult, eda, profile_eda
from tableprep.operators.features import FeaturePlan, plan_features
from tableprep.operators.outliers import OutlierPlan, plan_outliers
from tableprep.operators.profile import Profile, profile
from tableprep.plans.decide import MODES, Suggestions
from tableprep.session import scratch_scope, together, written
from tableprep.sources import registry
from tableprep.sources.tables import first_readable, is_text_source, read_table, write_table

REPORT_ERROR = "report answer could not be read"


@dataclass
class PreparationPlan:
    """A fitted preparation: apply it to any table or stream with the same columns."""

    cleaning: CleaningPlan = field(default_factory=CleaningPlan)
    outliers: OutlierPlan = field(default_factory=OutlierPlan)
    features: FeaturePlan = field(default_factory=FeaturePlan)

    @property
    def stateless(self) -> bool:
        return self.cleaning.stateless and self.outliers.stateless and self.features.stateless

    def apply(self, df: DataFrame) -> DataFrame:
        return self.features.apply(self.outliers.apply(self.cleaning.apply(df)))


@dataclass
class PrepResult:
    df: DataFrame
    plan: PreparationPlan
    cleaning_log: DataFrame
    outlier_log: DataFrame
    feature_log: DataFrame
    eda: EdaResult | None
    report: DataFrame | None
    rows: int
    columns: int


def _after_outliers(df: DataFrame, before: Profile, plan: OutlierPlan) -> Profile:
    """The profile after treatment: only the treated columns are new."""
    treated = [s.column for s in plan.steps]
    if not treated:
        return before
    fresh = profile(df, treated, quartiles=(), distinct=treated, screen=True)
    return Profile(before.rows, {n: fresh.columns.get(n, s) for n, s in before.columns.items()})


def _report(log: DataFrame, actions: int, answer: str | None) -> DataFrame | None:
    """One row: the parsed answer, or the standard report when it cannot be read."""
    if not actions or answer is None:
        return None
    row = log.sparkSession.createDataFrame([(answer, actions)], "answer string, actions int")
    parsed = parse_report(row)
    error = F.lit(REPORT_ERROR)
    spare = fallback_report(F.col("actions"), error)
    readable = F.col("reasoning").isNotNull()
    # an answer that can be read but explains nothing makes no report
    told = readable & (F.col("reasoning") == "")
    return parsed.filter((readable | ~is_quota_error(error)) & ~F.coalesce(told, F.lit(False))).select(
        F.when(readable, F.col("reasoning")).otherwise(spare[0]).alias("reasoning"),
        F.when(readable, F.col("summary")).otherwise(spare[1]).alias("summary"),
        F.when(readable, F.col("recommendations")).otherwise(spare[2]).alias("recommendations"),
    )


def prepare(
    df: DataFrame,
    mode: str = "fast",
    *,
    advice: DataFrame | None = None,
    feature_advice: Suggestions | dict | None = None,
    report_answer: str | None = None,
    order_by: Sequence[str] = (),
    keys: Sequence[str] = (),
    charts: bool = True,
    exact_distinct: bool = True,
) -> PrepResult:
    """Prepare a table.

    ``advice`` (column, action, reason) is used in modes smart and deep, ``report_answer`` in deep.
    Without ``exact_distinct`` the summary leaves distinct counts out where no decision needs them;
    the prepared table is the same, and the widest shuffle of the run is avoided.
    """
    if mode not in MODES:
        raise ValueError("Mode must be one of: fast, smart, deep")
    spark = df.sparkSession
    df = nan_to_null(df)
    gaps = profile_missing(df)
    plan = PreparationPlan(plan_cleaning(df, mode, advice, order_by, keys, gaps))
    cleaned = plan.cleaning.apply(df)
    if plan.cleaning.forward:
        cleaned = written(cleaned, "cleaned")
    whole = Profile(gaps.rows, {s.name: s for s in gaps if not s.nulls})
    stats = profile_eda(cleaned, whole, exact_distinct)

    def treat() -> DataFrame:
        plan.outliers = plan_outliers(cleaned, stats=stats)
        capped = plan.outliers.apply(cleaned)
        after = _after_outliers(capped, stats, plan.outliers)
        plan.features = plan_features(capped, advice=feature_advice, stats=after)
        return plan.features.apply(capped)

    final, drawn = together(treat, lambda: eda(cleaned, stats) if charts else None)
    log = plan.cleaning.log_frame(spark)
    return PrepResult(
        final,
        plan,
        log,
        plan.outliers.log_frame(spark),
        plan.features.log_frame(spark),
        drawn,
        _report(log, len(plan.cleaning.log), report_answer) if mode == "deep" else None,
        stats.rows,
        len(final.columns),
    )


def prepare_dataset(spark, root: str, dataset_id: str, prefix: str, fmt: str = "parquet", **options) -> PrepResult:
    """Prepare one registered dataset and record every outcome in the registry below ``root``.

    Each run writes a folder of its own (table, chart data, fitted plan) and tags its log rows; the
    registry row that points there comes last, so a repeated or broken run leaves one completed version
    (``registry.current_logs`` reads its logs).  Text sources are staged once as typed Parquet.  On
    failure a ``failed`` version is appended and the error is raised again; raw data is kept.
    """
    from tableprep.plans.store import load_plan, save_plan

    entry = registry.latest(registry.read(spark, "Dataset", root, dataset_id)).first()
    if entry is None:
        raise LookupError(f"no dataset {dataset_id}")

    def record(status: str, **changes) -> None:
        row = {**entry.asDict(), "updatedAt": None, "status": status, **changes}
        registry.append(spark.createDataFrame([row], registry.SCHEMAS["Dataset"]), "Dataset", root)

    record("processing")
    run = uuid.uuid4().hex[:12]
    folder = f"{prefix.rstrip('/')}/datasets/{dataset_id}/run-{run}"
    try:
        with scratch_scope(spark):
            path = entry["rawDataPath"]
            keyed = f"{prefix.rstrip('/')}/{path}" if path and "://" not in path and not path.startswith("/") else path
            source = first_readable(spark, entry["rawUrl"], keyed)
            if is_text_source(source):
                source = written(source, "typed")
            result = prepare(source, entry["mode"], **options)
            target = write_table(result.df, f"{folder}/cleaned.{fmt}", fmt)
            result.plan = load_plan(spark, save_plan(spark, result.plan, f"{folder}/plan"))
            result.df = read_table(spark, target, fmt)
            if result.eda is not None:
                result.eda = _stored_charts(spark, result.eda, f"{folder}/charts")
        _record_logs(spark, root, dataset_id, result, run)
        record("completed", cleanedUrl=target, rows=result.rows, columns=result.columns)
        return result
    except Exception:
        record("failed")
        raise


def _stored_charts(spark, charts: EdaResult, folder: str) -> EdaResult:
    """The chart data, written out, so that nothing of it needs the run's scratch files."""
    stored = {}
    for part in fields(charts):
        frame = getattr(charts, part.name)
        if frame is not None:
            frame.write.parquet(f"{folder}/{part.name}")
            frame = spark.read.schema(frame.schema).parquet(f"{folder}/{part.name}")
        stored[part.name] = frame
    return EdaResult(**stored)


def _record_logs(spark, root: str, dataset_id: str, result: PrepResult, run: str) -> None:
    tag = F.lit(dataset_id).alias("datasetId")
    name = F.concat(F.lit(f"run-{run}-"), F.expr("uuid()")).alias("id")
    registry.append(
        result.cleaning_log.select(name, tag, "column", F.col("null_count").alias("nullCount"), "action", "reason"),
        "CleaningLog",
        root,
    )
    registry.append(
        result.outlier_log.select(name, tag, "column", F.col("outlier_count").alias("outlierCount"), "method", "action"),
        "OutlierLog",
        root,
    )
    registry.append(result.feature_log.select(name, tag, "action", "details"), "FeatureLog", root)
    if result.eda is not None:
        charts = result.eda.manifest.select(
            name,
            tag,
            "type",
            "column",
            F.concat_ws("_", F.lit(f"graphs/{dataset_id}/{dataset_id}"), "type", "column").alias("filePath"),
        )
        registry.append(charts, "GraphMetadata", root)
    if result.report is not None:
        registry.append(result.report.select(name, tag, "*"), "CleaningReport", root)


def registry_row(result: PrepResult, dataset_id: str) -> DataFrame:
    """The dataset's final registry facts."""
    return result.df.sparkSession.createDataFrame(
        [(dataset_id, "completed", result.rows, result.columns)],
        "id string, status string, rows bigint, columns int",
    )
