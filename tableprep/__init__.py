"""Profile, clean and prepare tables with Spark: profile once, decide per column, apply in one projection."""

from tableprep.operators.clean import CleaningPlan, clean, fill, plan_cleaning
from tableprep.operators.eda import eda, head
from tableprep.operators.features import FeaturePlan, encode_labels, encode_one_hot, engineer, plan_features, scale
from tableprep.operators.ordered import forward_fill
from tableprep.operators.outliers import OutlierPlan, detect_outliers, plan_outliers, treat_column, treat_outliers
from tableprep.operators.profile import ColumnStats, Profile, profile
from tableprep.operators.rate import admission, audit, sliding_counts
from tableprep.plans.prepare import PreparationPlan, PrepResult, prepare, prepare_dataset
from tableprep.session import local_session
from tableprep.sources.tables import read_any, read_csv, read_json, read_table, write_table

__all__ = [
    "CleaningPlan",
    "ColumnStats",
    "FeaturePlan",
    "OutlierPlan",
    "PrepResult",
    "PreparationPlan",
    "Profile",
    "admission",
    "audit",
    "clean",
    "detect_outliers",
    "eda",
    "encode_labels",
    "encode_one_hot",
    "engineer",
    "fill",
    "forward_fill",
    "head",
    "local_session",
    "plan_cleaning",
    "plan_features",
    "plan_outliers",
    "prepare",
    "prepare_dataset",
    "profile",
    "read_any",
    "read_csv",
    "read_json",
    "read_table",
    "scale",
    "sliding_counts",
    "treat_column",
    "treat_outliers",
    "write_table",
]
