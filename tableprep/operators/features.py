"""Feature engineering: encoders, scalers, buckets, and the planner that chooses among them.

A plan is fitted once and holds only literals and dictionaries, so the same plan prepares other
tables and streams.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprep.functions.exprs import cut, min_max_scaled, standardised
from tableprep.functions.types import (
    col,
    dtype_of,
    nan_to_null,
    number_columns,
    python_text,
    text_columns,
    text_literal,
)
from tableprep.operators import frequencies
from tableprep.operators.ordered import numbered
from tableprep.operators.profile import Profile, profile
from tableprep.plans.decide import Suggestions, feature_suggestions, wants_feature_advice
from tableprep.session import together, written

LOG_SCHEMA = "seq int, action string, details string"
MISSING_LABEL = "nan"
MOST_ONE_HOT = 10_000  # columns that one column may become unless more are asked for
SMALL_DICTIONARY = 50_000
SMALL_DICTIONARY_BYTES = 32 * 1024 * 1024
HOT_SHARE = 0.001
SPREAD = 4096

# The age buckets.
AGE_COLUMN = "Age"
AGE_BINS = [0, 18, 35, 50, 100]
AGE_LABELS = ["Young", "Adult", "Middle", "Senior"]


@dataclass
class OneHot:
    """One boolean column per value, appended at the end; the source goes away."""

    column: str
    dtype: str
    values: list[str]

    def outputs(self) -> list[tuple[str, Column]]:
        c = col(self.column)
        return [
            (
                f"{self.column}_{python_text(v, self.dtype)}",
                F.coalesce(c == text_literal(v, self.dtype), F.lit(False)),
            )
            for v in self.values
        ]


@dataclass
class LabelCodes:
    """Codes 0..k-1 by sorted text; missing values count as the text ``nan``.

    A small dictionary is broadcast.  A large one is keyed by short texts or digests and joined by
    shuffle.  Its frequent values (each on at least a thousandth of the rows, so a bounded list) get
    their codes from a broadcast beforehand and go through the shuffle under spread keys that match
    nothing: no task then receives all rows of one hot value, and the input is read once.
    """

    column: str
    dictionary: DataFrame  # (label string, code bigint)
    small: bool
    hot: list[str] = field(default_factory=list)

    def apply(self, df: DataFrame) -> DataFrame:
        text = F.coalesce(col(self.column).cast("string"), F.lit(MISSING_LABEL))
        label = text if self.small else frequencies.short_key(text)
        others = [col(c) for c in df.columns if c != self.column]
        # The text itself is not needed past this point and does not travel through the join.
        rest = df.select(*others, label.alias("__label"))
        codes = self.dictionary.select(F.col("label").alias("__label"), F.col("code").alias("__code"))
        if self.small:
            out = rest.join(F.broadcast(codes), "__label", "left")
        elif not self.hot:
            out = rest.join(codes, "__label", "left")
        else:
            hot = codes.filter(F.col("__label").isin(self.hot)).withColumnRenamed("__code", "__hot")
            met = rest.join(F.broadcast(hot), "__label", "left")
            spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*others, F.lit(7)), F.lit(SPREAD)).cast("string"))
            keyed = met.withColumn("__label", F.when(F.col("__hot").isNull(), F.col("__label")).otherwise(spread))
            cold = codes.withColumn("__cold", F.lit(True))
            matched = keyed.withColumn("__cold", F.col("__hot").isNull()).join(cold, ["__label", "__cold"], "left")
            out = matched.withColumn("__code", F.coalesce("__hot", "__code"))
        return out.select(*[(F.col("__code").alias(c) if c == self.column else col(c)) for c in df.columns])


@dataclass
class Scale:
    column: str
    method: str  # standard | min-max
    a: float | None
    b: float | None

    def expr(self) -> Column:
        maker = standardised if self.method == "standard" else min_max_scaled
        return maker(col(self.column), self.a, self.b)


@dataclass
class Bucket:
    name: str
    source: str
    bins: list[float]
    labels: list[str]

    def expr(self) -> Column:
        return cut(col(self.source), self.bins, self.labels)


@dataclass
class FeaturePlan:
    """Encode, then scale, drop and derive; each stage is one projection."""

    one_hot: list[OneHot] = field(default_factory=list)
    labels: list[LabelCodes] = field(default_factory=list)
    scales: list[Scale] = field(default_factory=list)
    drops: list[str] = field(default_factory=list)
    buckets: list[Bucket] = field(default_factory=list)
    log: list[tuple[str, str]] = field(default_factory=list)

    @property
    def stateless(self) -> bool:
        return True

    def encode(self, df: DataFrame) -> DataFrame:
        df = nan_to_null(df)
        for step in self.labels:
            df = step.apply(df)
        if not self.one_hot:
            return df
        gone = {s.column for s in self.one_hot}
        added = [pair for s in self.one_hot for pair in s.outputs()]
        kept = [c for c in df.columns if c not in gone]
        clash = {n for n, _ in added} & set(kept)
        if clash:
            raise ValueError(f"one-hot columns already exist: {sorted(clash)}")
        return df.select(*[col(c) for c in kept], *[e.alias(n) for n, e in added])

    def finish(self, df: DataFrame) -> DataFrame:
        scales = {s.column: s for s in self.scales}
        derived = {b.name: b for b in self.buckets}
        kept = [c for c in df.columns if c not in self.drops]
        if not (scales or derived or self.drops):
            return df
        # Buckets read the scaled values: they are derived last.
        scaled = df.select(*[(scales[c].expr().alias(c) if c in scales else col(c)) for c in kept])
        out = [(derived[c].expr().alias(c) if c in derived else col(c)) for c in kept]
        out += [b.expr().alias(n) for n, b in derived.items() if n not in kept]
        return scaled.select(*out)

    def apply(self, df: DataFrame) -> DataFrame:
        return self.finish(self.encode(df))

    def log_frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, *row) for i, row in enumerate(self.log)], LOG_SCHEMA)


def fit_one_hot(df: DataFrame, columns: Sequence[str], most: int = MOST_ONE_HOT) -> list[OneHot]:
    """Sorted values of each column, all columns of one type in one job.

    Every value becomes a column.  A column with more than ``most`` values is refused, and no more than
    that travel to the driver.
    """
    found: dict[str, list[str]] = {c: [] for c in columns}
    by_value = Window.partitionBy("slot").orderBy("value")
    for _, names, counts in frequencies.value_counts(df, columns):
        listed = counts.withColumn("at", F.row_number().over(by_value))
        # One value above the limit is enough to refuse; the rank filter is applied before the shuffle.
        listed = listed.filter(F.col("at") <= most + 1)
        for row in listed.select("slot", "at", F.col("value").cast("string").alias("text")).collect():
            found[names[int(row["slot"][1:])]].append((row["at"], row["text"]))
    wide = [c for c, values in found.items() if len(values) > most]
    if wide:
        raise ValueError(f"one-hot of {wide} would add more than {most} columns; use label codes")
    return [OneHot(c, dtype_of(df, c).simpleString(), [v for _, v in sorted(found[c])]) for c in columns]


def fit_labels(df: DataFrame, columns: Sequence[str], small: int = SMALL_DICTIONARY) -> list[LabelCodes]:
    """The dictionaries of several columns.

    Up to ``small`` values a dictionary is collected and becomes a literal table; all of those share
    two jobs, and their bytes together stay below a bound.  Other dictionaries stay distributed: values
    are sorted across partitions, numbered by their places and written once.
    """
    if not columns:
        return []
    texts = df.select(
        *[F.coalesce(col(c).cast("string"), F.lit(MISSING_LABEL)).alias(f"c{i}") for i, c in enumerate(columns)]
    )
    slots = texts.columns
    long = texts.unpivot([], slots, "slot", "label")
    keyed = long.groupBy("slot", frequencies.short_key(F.col("label")).alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.octet_length("label")).alias("bytes")
    )
    totals = [F.count(F.lit(1)).alias("labels"), F.sum("bytes").alias("bytes"), F.sum("n").alias("rows")]
    sizes = {r["slot"]: r for r in keyed.groupBy("slot").agg(*totals).collect()}
    little = _smallest(slots, sizes, small)
    labels: dict[str, list[str]] = {s: [] for s in little}
    if little:
        for r in long.filter(F.col("slot").isin(little)).distinct().collect():
            labels[r["slot"]].append(r["label"])
    out = []
    for slot, column in zip(slots, columns):
        if slot in labels:
            ordered = sorted(labels[slot], key=lambda v: v.encode())
            rows = list(zip(ordered, range(len(ordered))))
            out.append(LabelCodes(column, df.sparkSession.createDataFrame(rows, "label string, code bigint"), True))
        else:
            out.append(_large_labels(texts.select(F.col(slot).alias("label")), column, sizes[slot]["rows"]))
    return out


def _smallest(slots: list[str], sizes: dict, small: int) -> list[str]:
    """Columns whose dictionaries have few labels and, smallest first, fit the driver together."""
    room, out = SMALL_DICTIONARY_BYTES, []
    for slot in sorted(slots, key=lambda s: sizes[s]["bytes"] if s in sizes else 0):
        size = sizes.get(slot)
        if size is None:
            out.append(slot)
        elif size["labels"] <= small and size["bytes"] <= room:
            out.append(slot)
            room -= size["bytes"]
    return out


def _large_labels(texts: DataFrame, column: str, rows: int) -> LabelCodes:
    counts = written(texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "labels")
    key = frequencies.short_key(F.col("label")).alias("label")
    dictionary = written(numbered(counts, ["label"], "code").select(key, F.col("code").cast("bigint")), "dictionary")
    hot = counts.filter(F.col("n") >= HOT_SHARE * rows).select(key).collect()
    return LabelCodes(column, dictionary, False, [r["label"] for r in hot])


def fit_scales(df: DataFrame, methods: dict[str, str]) -> list[Scale]:
    if not methods:
        return []
    stats = profile(df, list(methods), quartiles=())
    out = []
    for name, method in methods.items():
        s = stats[name]
        a, b = (s.mean, s.std_pop) if method == "standard" else (s.low, s.high)
        out.append(Scale(name, method, a, b))
    return out


def normalised_advice(advice: Suggestions | dict | None) -> Suggestions | None:
    if advice is None or isinstance(advice, Suggestions):
        return advice
    return Suggestions(
        list(advice.get("encoding", [])),
        list(advice.get("scaling", [])),
        list(advice.get("drop", [])),
        list(advice.get("new_features", [])),
    )


def profile_features(df: DataFrame) -> Profile:
    """What the heuristics read: moments, and distinct counts where they can decide something."""
    return profile(df, quartiles=(), distinct=None, screen=True)


def plan_features(
    df: DataFrame,
    *,
    scaling: bool = False,
    encoding: bool = True,
    dropping: bool = False,
    advice: Suggestions | dict | None = None,
    stats: Profile | None = None,
) -> FeaturePlan:
    """Fit encoders and scalers; a step that is not enabled is only logged as a suggestion.

    ``advice`` replaces the heuristics on tables wide enough to ask about.
    """
    df = nan_to_null(df)
    advice = normalised_advice(advice)
    if advice is None or not wants_feature_advice(len(df.columns), bool(text_columns(df))):
        advice = feature_suggestions(stats or profile_features(df))
    plan = FeaturePlan()
    present = list(df.columns)
    encoded = _plan_encoding(df, advice.encoding, encoding, plan, present)
    _plan_scaling(encoded, advice.scaling, scaling, plan, present)
    for spec in advice.drop:
        name = spec.get("column") if isinstance(spec, dict) else spec
        reason = (spec.get("reason") if isinstance(spec, dict) else None) or "Low importance"
        if name in present:
            plan.log.append((f"Dropped '{name}'" if dropping else f"Suggested: drop '{name}'", reason))
            if dropping:
                present.remove(name)
                plan.drops.append(name)
    _plan_derived(advice.new_features, plan, present)
    return plan


def _plan_encoding(df: DataFrame, specs: list[dict], enabled: bool, plan: FeaturePlan, present: list[str]) -> DataFrame:
    one_hot: list[str] = []
    labelled: list[str] = []
    for spec in specs:
        name, method = spec.get("column"), spec.get("method") or "label"
        reason = spec.get("reason") or "Categorical encoding needed"
        if name not in present:
            continue
        if not enabled:
            plan.log.append((f"Suggested: encode '{name}' ({method})", reason))
        elif method == "one-hot" and name not in labelled:
            one_hot.append(name)
            present.remove(name)
            plan.log.append((f"Encoded '{name}' (one-hot)", reason))
        elif method == "label" and name not in labelled:
            labelled.append(name)
            plan.log.append((f"Encoded '{name}' (label)", reason))
    plan.one_hot, plan.labels = together(lambda: fit_one_hot(df, one_hot), lambda: fit_labels(df, labelled))
    encoded = plan.encode(df) if one_hot or labelled else df
    present.extend(c for c in encoded.columns if c not in present)
    return encoded


def _plan_scaling(df: DataFrame, specs: list[dict], enabled: bool, plan: FeaturePlan, present: list[str]) -> None:
    numeric = set(number_columns(df))
    methods: dict[str, str] = {}
    for spec in specs:
        name, method = spec.get("column"), spec.get("method") or "standard"
        reason = spec.get("reason") or "Feature scaling needed"
        if name not in present or name not in numeric:
            continue
        if not enabled:
            plan.log.append((f"Suggested: scale '{name}' ({method})", reason))
        elif method in ("standard", "min-max") and name not in methods:
            methods[name] = method
            plan.log.append((f"Scaled '{name}' ({method})", reason))
    plan.scales = fit_scales(df, methods)


def _plan_derived(specs: list[dict], plan: FeaturePlan, present: list[str]) -> None:
    for spec in specs:
        name, description = spec.get("name") or "", spec.get("description") or ""
        details = spec.get("reason") or description
        if "age" not in description.lower() and "age" not in name.lower():
            plan.log.append((f"Suggested: create '{name}'", details))
        elif AGE_COLUMN in present:
            plan.buckets.append(Bucket(name, AGE_COLUMN, AGE_BINS, AGE_LABELS))
            plan.log.append((f"Created '{name}'", details))


def engineer(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Engineered table and its log ``(seq, action, details)``."""
    plan = plan_features(df, **options)
    return plan.apply(df), plan.log_frame(df.sparkSession)


def encode_one_hot(df: DataFrame, column: str, most: int = MOST_ONE_HOT) -> DataFrame:
    df = nan_to_null(df)
    return FeaturePlan(one_hot=fit_one_hot(df, [column], most)).apply(df)


def encode_labels(df: DataFrame, column: str | Sequence[str], **options) -> DataFrame:
    """Label codes of one column or of several."""
    df = nan_to_null(df)
    columns = [column] if isinstance(column, str) else list(column)
    return FeaturePlan(labels=fit_labels(df, columns, **options)).apply(df)


def scale(df: DataFrame, column: str, method: str) -> DataFrame:
    df = nan_to_null(df)
    return FeaturePlan(scales=fit_scales(df, {column: method})).apply(df)
