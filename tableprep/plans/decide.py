"""Per-column decisions: small, pure functions of the profile, run on the driver.

The thresholds and the wording are fixed values that results and logs depend on.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from tableprep.operators.profile import ColumnStats, Profile

# Thresholds.
MAX_NULL_SHARE = 0.8
SMALL_SPREAD = 0.3
HIGH_CARDINALITY_SHARE = 0.5
MAX_OUTLIER_SHARE = 0.1
ONE_HOT_VALUES = 10
HIGH_VARIATION = 1
USEFUL_CATEGORY_VALUES = 50
USEFUL_CATEGORIES = 5
CHARTED_NUMBERS = 5
ADVICE_BUDGET = {"smart": 3, "deep": 3}
ADVICE_NULL_SHARE = {"smart": 0.2, "deep": 0.1}
MODES = ("fast", "smart", "deep")
FILL_ACTIONS = ("mean", "median", "mode", "unknown", "forward_fill", "drop_column")
OUTPUT_KEYWORDS = ("target", "label", "y", "output", "class")


@dataclass(frozen=True)
class Decision:
    action: str
    reason: str


def missing_strategy(s: ColumnStats) -> Decision:
    """What to do about a column's missing values when nobody advises otherwise."""
    if s.null_share > MAX_NULL_SHARE:
        return Decision("drop_column", f"Too many nulls ({s.null_share:.1%})")
    if s.kind == "number":
        if not s.std:
            return Decision("drop_column", "Zero variance")
        spread = s.high - s.low
        if spread > 0 and s.iqr / spread < SMALL_SPREAD:
            return Decision("median", "Outliers present, median more robust")
        return Decision("mean", "Normal distribution, mean appropriate")
    if s.kind == "other":
        return Decision("keep", f"Type {s.dtype} is not filled")
    if s.rows and s.distinct / s.rows > HIGH_CARDINALITY_SHARE:
        return Decision("unknown", "High cardinality categorical")
    return Decision("mode", "Low cardinality, mode appropriate")


def null_ranking(profile: Profile) -> list[ColumnStats]:
    """Columns with missing values, most affected first, table order on ties."""
    return sorted((s for s in profile if s.nulls), key=lambda s: (-s.null_share, -s.nulls))


def advice_threshold(mode: str) -> float | None:
    return ADVICE_NULL_SHARE.get(mode)


def advice_candidates(profile: Profile, mode: str) -> list[ColumnStats]:
    """The columns worth asking about, within the mode's budget."""
    floor = advice_threshold(mode)
    if floor is None:
        return []
    return [s for s in null_ranking(profile) if s.null_share > floor][: ADVICE_BUDGET[mode]]


def choose_strategies(profile: Profile, mode: str, advice: dict[str, Decision]) -> list[tuple[ColumnStats, Decision]]:
    """Ranked columns with their decisions; advice is spent only on columns it exists for."""
    budget, floor = ADVICE_BUDGET.get(mode, 0), advice_threshold(mode)
    out = []
    for s in null_ranking(profile):
        if budget and floor is not None and s.null_share > floor and s.name in advice:
            out.append((s, advice[s.name]))
            budget -= 1
        else:
            out.append((s, missing_strategy(s)))
    return out


@dataclass
class Suggestions:
    """Feature work to do; every entry is a dict as an advice table would hold it."""

    encoding: list[dict] = field(default_factory=list)
    scaling: list[dict] = field(default_factory=list)
    drop: list = field(default_factory=list)
    new_features: list[dict] = field(default_factory=list)


def feature_suggestions(profile: Profile) -> Suggestions:
    out = Suggestions()
    for s in profile:
        if s.kind == "string":
            one_hot = s.at_most(ONE_HOT_VALUES)
            out.encoding.append(
                {
                    "column": s.name,
                    "method": "one-hot" if one_hot else "label",
                    "reason": "Low cardinality" if one_hot else "High cardinality",
                }
            )
        if s.kind == "number" and s.std:
            variation = s.std / abs(s.mean) if s.mean else 0
            if variation > HIGH_VARIATION:
                out.scaling.append({"column": s.name, "method": "standard", "reason": "High variance"})
        if s.kind == "other":
            continue
        if s.constant:
            out.drop.append({"column": s.name, "reason": "Constant column"})
        elif s.unique:
            out.drop.append({"column": s.name, "reason": "Unique identifier"})
    return out


def wants_feature_advice(columns: int, has_text: bool, min_columns: int = 5) -> bool:
    return columns >= min_columns and (has_text or columns > 10)


def feature_roles(columns: list[str]) -> list[tuple[str, str]]:
    """``(column, 'input' | 'output')``: a keyword anywhere in the name marks an output."""
    roles = [(c, "output" if any(k in c.lower() for k in OUTPUT_KEYWORDS) else "input") for c in columns]
    if roles and all(role == "input" for _, role in roles):
        roles[-1] = (columns[-1], "output")
    return roles


def top_variance(profile: Profile, k: int = CHARTED_NUMBERS) -> list[ColumnStats]:
    """The ``k`` number columns with the largest sample variance; unknown variance last."""
    numbers = profile.of_kind("number")
    return sorted(numbers, key=lambda s: (s.variance is None, -(s.variance or 0.0)))[:k]


def useful_categories(profile: Profile, k: int = USEFUL_CATEGORIES) -> list[ColumnStats]:
    """The first ``k`` text columns with more than one and at most fifty values."""
    texts = profile.of_kind("string")
    return [s for s in texts if s.at_most(USEFUL_CATEGORY_VALUES) and not s.constant][:k]
