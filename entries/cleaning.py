"""Missing values, outliers and features over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries.common import GAPPY, Derived, gap, query, rounded, sql_fences, sql_mode, table, union_all
from tableprep.functions.exprs import cut
from tableprep.operators import advice as answers
from tableprep.operators import features as feats
from tableprep.operators.clean import clean, fill, plan_cleaning, profile_missing
from tableprep.operators.features import engineer, plan_features, profile_features
from tableprep.operators.ordered import forward_fill
from tableprep.operators.outliers import detect_outliers, plan_outliers, treat_column, treat_outliers
from tableprep.plans import decide
from tableprep.plans.prepare import PreparationPlan, prepare, registry_row
from tableprep.plans.store import load_plan, save_plan
from tableprep.session import scratch_path

# ---------------------------------------------------------------- missing values

PRICES = Derived("orders", ["o_orderkey", gap("o_orderkey % 10 = 0", "o_totalprice")])
SIZES = Derived("part", ["p_partkey", gap("p_partkey % 5 = 0", "p_size")])
VALUES = Derived("events", ["event_id", "ts", "user_id", gap("event_id % 7 = 0", "value")])
LENGTHS = Derived("documents", ["doc_id", gap("doc_id % 4 = 0", "n_chars")])
KINDS = Derived("events", ["event_id", gap("event_id % 3 = 0", "event_type")])
NAMES = Derived("customer", ["c_custkey", gap("c_custkey % 8 = 0", "c_name")])


@query(
    "fill_mean",
    f"WITH d AS ({PRICES.sql}) SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM d)), 4) "
    "AS o_totalprice FROM d",
)
def fill_mean(spark, sf_dir):
    return rounded(fill(PRICES.frame(spark, sf_dir), "o_totalprice", "mean"), "o_totalprice", digits=4)


@query(
    "fill_mean_int",
    f"WITH d AS ({SIZES.sql}) SELECT p_partkey, coalesce(p_size, (SELECT round_even(avg(p_size), 0)::INT FROM d)) AS p_size FROM d",
)
def fill_mean_int(spark, sf_dir):
    return fill(SIZES.frame(spark, sf_dir), "p_size", "mean")


@query(
    "fill_median",
    f"WITH d AS ({VALUES.sql}) SELECT event_id, round(coalesce(value, (SELECT median(value) FROM d)), 6) AS value FROM d",
)
def fill_median(spark, sf_dir):
    return rounded(fill(VALUES.frame(spark, sf_dir), "value", "median").select("event_id", "value"), "value")


@query(
    "fill_median_int",
    f"WITH d AS ({LENGTHS.sql}) SELECT doc_id, coalesce(n_chars, (SELECT round_even(median(n_chars), 0)::BIGINT FROM d)) AS n_chars FROM d",
)
def fill_median_int(spark, sf_dir):
    return fill(LENGTHS.frame(spark, sf_dir), "n_chars", "median")


@query(
    "fill_mode",
    f"WITH d AS ({KINDS.sql}) SELECT event_id, coalesce(event_type, {sql_mode('event_type', 'd')}) AS event_type FROM d",
)
def fill_mode(spark, sf_dir):
    return fill(KINDS.frame(spark, sf_dir), "event_type", "mode")


@query("fill_unknown", f"SELECT c_custkey, coalesce(c_name, 'Unknown') AS c_name FROM ({NAMES.sql})")
def fill_unknown(spark, sf_dir):
    return fill(NAMES.frame(spark, sf_dir), "c_name", "unknown")


@query(
    "forward_fill",
    f"SELECT event_id, last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id) AS value FROM ({VALUES.sql})",
)
def forward_fill_table(spark, sf_dir):
    return forward_fill(VALUES.frame(spark, sf_dir), ["value"], ["ts", "event_id"]).select("event_id", "value")


@query(
    "forward_fill_keyed",
    f"SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value FROM ({VALUES.sql})",
)
def forward_fill_keyed(spark, sf_dir):
    out = forward_fill(VALUES.frame(spark, sf_dir), ["value"], ["ts", "event_id"], ["user_id"])
    return out.select("event_id", "user_id", "value")


@query(
    "fill_default",
    f"WITH d AS ({GAPPY.sql}) SELECT event_id, round(coalesce(value, (SELECT median(value) FROM d)), 6) AS value, "
    f"coalesce(event_type, {sql_mode('event_type', 'd')}) AS event_type FROM d",
)
def fill_default(spark, sf_dir):
    df = fill(GAPPY.frame(spark, sf_dir), "value", "interpolate")
    return rounded(fill(df, "event_type", "interpolate").select("event_id", "value", "event_type"), "value")


CLEANED = (
    f"WITH d AS ({GAPPY.sql}), cleaned AS (SELECT event_id, ts, coalesce(event_type, {sql_mode('event_type', 'd')}) AS event_type, "
    "coalesce(value, (SELECT median(value) FROM d)) AS value, "
    f"coalesce(props, {sql_mode('props', 'd')}) AS props, "
    "coalesce(user_ref, (SELECT round_even(avg(user_ref), 0)::BIGINT FROM d)) AS user_ref FROM d)"
)


@query("clean_fast", CLEANED + " SELECT event_id, ts, event_type, round(value, 6) AS value, props, user_ref FROM cleaned")
def clean_fast(spark, sf_dir):
    return rounded(clean(GAPPY.frame(spark, sf_dir))[0], "value")


def _advice(spark):
    return spark.createDataFrame(
        [
            ("props", "forward_fill", "events come in order"),
            ("event_type", "unknown", "keep the gap visible"),
            ("value", "mean", "symmetric enough"),
            ("user_ref", "drop_column", "below the threshold, so never used"),
        ],
        "column string, action string, reason string",
    )


@query(
    "clean_advised",
    f"WITH d AS ({GAPPY.sql}) SELECT event_id, ts, coalesce(event_type, 'Unknown') AS event_type, "
    "round(coalesce(value, (SELECT avg(value) FROM d)), 6) AS value, "
    "last_value(props IGNORE NULLS) OVER (ORDER BY ts, event_id) AS props, "
    "coalesce(user_ref, (SELECT round_even(avg(user_ref), 0)::BIGINT FROM d)) AS user_ref FROM d",
)
def clean_advised(spark, sf_dir):
    out, _ = clean(GAPPY.frame(spark, sf_dir), "deep", _advice(spark), order_by=["ts", "event_id"])
    return rounded(out, "value")


_SHARE = "(SELECT printf('%.1f', 100.0 * (count(*) - count({c})) / count(*)) FROM d)"
_NULLS = "(SELECT count(*) - count({c}) FROM d)"


@query(
    "cleaning_log",
    f"WITH d AS ({GAPPY.sql}) SELECT row_number() OVER (ORDER BY null_count DESC, position) - 1 AS seq, column_name, null_count, action, reason FROM ("
    + union_all(
        [
            f"SELECT {i} AS position, '{c}' AS column_name, {_NULLS.format(c=c)} AS null_count, {action} AS action, {reason} AS reason"
            for i, (c, action, reason) in enumerate(
                [
                    (
                        "event_type",
                        f"'Filled with mode (' || {sql_mode('event_type', 'd')} || ')'",
                        "'Low cardinality, mode appropriate'",
                    ),
                    (
                        "value",
                        "(SELECT printf('Filled with median (%.2f)', median(value)) FROM d)",
                        "'Outliers present, median more robust'",
                    ),
                    (
                        "props",
                        f"'Filled with mode (' || {sql_mode('props', 'd')} || ')'",
                        "'Low cardinality, mode appropriate'",
                    ),
                    (
                        "mostly_missing",
                        "'Dropped column'",
                        f"'Too many nulls (' || {_SHARE.format(c='mostly_missing')} || '%)'",
                    ),
                    ("constant", "'Dropped column'", "'Zero variance'"),
                    (
                        "user_ref",
                        "(SELECT printf('Filled with mean (%.2f)', round_even(avg(user_ref), 0)::DOUBLE) FROM d)",
                        "'Normal distribution, mean appropriate'",
                    ),
                ]
            )
        ]
    )
    + ")",
)
def cleaning_log(spark, sf_dir):
    log = plan_cleaning(GAPPY.frame(spark, sf_dir)).log_frame(spark)
    return log.withColumnRenamed("column", "column_name").withColumn("seq", F.col("seq").cast("bigint"))


@query(
    "advice_candidates",
    f"WITH d AS ({GAPPY.sql}), r AS (SELECT column_name, position, n, n * 1.0 / (SELECT count(*) FROM d) AS share FROM ("
    + union_all(
        [f"SELECT {i} AS position, '{c}' AS column_name, {_NULLS.format(c=c)} AS n" for i, c in enumerate(
            ["event_type", "value", "props", "mostly_missing", "constant", "user_ref"])]
    )
    + ")) SELECT mode, column_name, seq FROM (SELECT 'smart' AS mode, column_name, row_number() OVER (ORDER BY n DESC, position) AS seq "
    "FROM r WHERE share > 0.2 UNION ALL SELECT 'deep', column_name, row_number() OVER (ORDER BY n DESC, position) FROM r WHERE share > 0.1) "
    "WHERE seq <= 3",
)
def advice_candidates(spark, sf_dir):
    stats = profile_missing(GAPPY.frame(spark, sf_dir))
    rows = [(m, s.name, i + 1) for m in ("smart", "deep") for i, s in enumerate(decide.advice_candidates(stats, m))]
    return spark.createDataFrame(rows, "mode string, column_name string, seq bigint")


@query(
    "advice_requests",
    f"WITH d AS ({GAPPY.sql}) "
    + union_all(
        [
            "SELECT 'mostly_missing' AS column_name, 'double' AS dtype, count(*) - count(mostly_missing) AS null_count, "
            "count(DISTINCT mostly_missing) AS unique_count, round(median(mostly_missing), 6) AS median_value, NULL::VARCHAR AS mode_value, "
            "'mean, median, mode, unknown, forward_fill, drop_column' AS actions FROM d",
            f"SELECT 'props', 'string', count(*) - count(props), count(DISTINCT props), NULL::DOUBLE, {sql_mode('props', 'd')}, "
            "'mean, median, mode, unknown, forward_fill, drop_column' FROM d",
            "SELECT 'constant', 'bigint', count(*) - count(constant), count(DISTINCT constant), median(constant)::DOUBLE, NULL::VARCHAR, "
            "'mean, median, mode, unknown, forward_fill, drop_column' FROM d",
        ]
    ),
)
def advice_requests(spark, sf_dir):
    out = answers.requests(GAPPY.frame(spark, sf_dir), "smart")
    facts = F.from_json("stats", "dtype string, null_count bigint, unique_count bigint, median double, mode string")
    return rounded(
        out.select(
            F.col("column").alias("column_name"),
            "dtype",
            "null_count",
            facts["unique_count"].alias("unique_count"),
            facts["median"].alias("median_value"),
            facts["mode"].alias("mode_value"),
            "actions",
        ),
        "median_value",
    )


# ---------------------------------------------------------------- outliers

FENCES = sql_fences("value", "events")


@query("outliers_iqr", f"SELECT event_id, value < lo OR value > hi AS is_outlier FROM events, {FENCES}")
def outliers_iqr(spark, sf_dir):
    return detect_outliers(table(spark, sf_dir, "events"), "value").select("event_id", "is_outlier")


@query(
    "outliers_zscore",
    "SELECT event_id, abs((value - m) / s) > 3 AS is_outlier FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)",
)
def outliers_zscore(spark, sf_dir):
    return detect_outliers(table(spark, sf_dir, "events"), "value", "Z-score").select("event_id", "is_outlier")


@query(
    "outlier_cap",
    f"SELECT event_id, round(CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END, 6) AS value FROM ({VALUES.sql}), "
    f"{sql_fences('value', f'({VALUES.sql})')}",
)
def outlier_cap(spark, sf_dir):
    return rounded(treat_column(VALUES.frame(spark, sf_dir), "value", "cap").select("event_id", "value"), "value")


@query(
    "outlier_cap_int",
    "SELECT doc_id, CASE WHEN n_chars < round_even(lo, 0)::BIGINT THEN round_even(lo, 0)::BIGINT "
    f"WHEN n_chars > round_even(hi, 0)::BIGINT THEN round_even(hi, 0)::BIGINT ELSE n_chars END AS n_chars FROM documents, {sql_fences('n_chars', 'documents')}",
)
def outlier_cap_int(spark, sf_dir):
    return treat_column(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "cap")


@query(
    "outlier_median",
    f"SELECT event_id, round(CASE WHEN value < lo OR value > hi THEN (SELECT median(value) FROM events) ELSE value END, 6) AS value FROM events, {FENCES}",
)
def outlier_median(spark, sf_dir):
    out = treat_column(table(spark, sf_dir, "events"), "value", "replace_median")
    return rounded(out.select("event_id", "value"), "value")


TWO_TAILS = Derived("events", ["event_id", "value", "value * (event_id % 17) AS spread"])


def _gate(column: str, source: str) -> str:
    """Rows of ``source`` kept after removing the column's outliers, if their share allows it."""
    return (
        f"SELECT t.* FROM {source} t, {sql_fences(column, source)} f, (SELECT count(*) FILTER ({column} < lo OR {column} > hi) * 1.0 / count(*) AS share "
        f"FROM {source}, {sql_fences(column, source)} g) s WHERE s.share > 0.2 OR NOT ({column} < lo OR {column} > hi)"
    )


@query(
    "outlier_remove",
    f"WITH d AS ({TWO_TAILS.sql}), a AS ({_gate('value', 'd')}), b AS ({_gate('spread', 'a')}) "
    "SELECT event_id, round(value, 6) AS value, round(spread, 6) AS spread FROM b",
)
def outlier_remove(spark, sf_dir):
    out, _ = treat_outliers(TWO_TAILS.frame(spark, sf_dir), strategy="remove", max_share=0.2)
    return rounded(out, "value", "spread")


PLAN_COLUMNS = [
    ("events", "value"),
    ("documents", "n_chars"),
    ("labels", "quality"),
    ("labels", "toxic"),
    ("part", "p_retailprice"),
]


@query(
    "outlier_plan",
    "SELECT table_name, column_name, n AS outlier_count, CASE WHEN n * 1.0 / total > 0.1 THEN 'skip' ELSE 'treat' END AS decision FROM ("
    + union_all(
        [
            f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) FILTER ({c} < lo OR {c} > hi) AS n, count(*) AS total, "
            f"count(DISTINCT {c}) AS k FROM {t}, {sql_fences(c, t)}"
            for t, c in PLAN_COLUMNS
        ]
    )
    + ") WHERE n > 0 AND k > 1",
)
def outlier_plan(spark, sf_dir):
    rows = []
    for name in dict.fromkeys(t for t, _ in PLAN_COLUMNS):
        plan = plan_outliers(table(spark, sf_dir, name).select(*[c for t, c in PLAN_COLUMNS if t == name]))
        treated = {s.column for s in plan.steps}
        rows += [(name, c, n, "treat" if c in treated else "skip") for c, n, _, _ in plan.log]
    return spark.createDataFrame(rows, "table_name string, column_name string, outlier_count bigint, decision string")


def _capped(column: str, source: str) -> str:
    return (
        f"CASE WHEN (SELECT count(*) FILTER ({column} < lo OR {column} > hi) * 1.0 / count(*) FROM {source}, {sql_fences(column, source)} g) > 0.1 "
        f"THEN {column} WHEN {column} < (SELECT lo FROM {sql_fences(column, source)} h) THEN (SELECT lo FROM {sql_fences(column, source)} h) "
        f"WHEN {column} > (SELECT hi FROM {sql_fences(column, source)} h) THEN (SELECT hi FROM {sql_fences(column, source)} h) ELSE {column} END"
    )


@query("outlier_pipeline", f"SELECT event_id, ts, user_id, event_type, round({_capped('value', 'events')}, 6) AS value, props FROM events")
def outlier_pipeline(spark, sf_dir):
    return rounded(treat_outliers(table(spark, sf_dir, "events"))[0], "value")


@query(
    "outlier_zscore_cap",
    f"SELECT event_id, round(CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END, 6) AS value FROM events, {FENCES}",
)
def outlier_zscore_cap(spark, sf_dir):
    out, _ = treat_outliers(table(spark, sf_dir, "events"), "Z-score", "cap")
    return rounded(out.select("event_id", "value"), "value")


@query(
    "outlier_log",
    union_all(
        [
            f"SELECT '{t}' AS table_name, '{c}' AS column_name, n AS outlier_count, 'IQR' AS method, CASE WHEN n * 1.0 / total > 0.1 THEN "
            "printf('Skipped (outlier percentage %.1f%% > 10.0%%)', 100.0 * n / total) ELSE 'Capped to upper/lower bound' END AS action FROM ("
            f"SELECT count(*) FILTER ({c} < lo OR {c} > hi) AS n, count(*) AS total, count(DISTINCT {c}) AS k FROM {t}, {sql_fences(c, t)}) WHERE n > 0 AND k > 1"
            for t, c in PLAN_COLUMNS
        ]
    ),
)
def outlier_log(spark, sf_dir):
    rows = []
    for name in dict.fromkeys(t for t, _ in PLAN_COLUMNS):
        plan = plan_outliers(table(spark, sf_dir, name).select(*[c for t, c in PLAN_COLUMNS if t == name]))
        rows += [(name, *entry) for entry in plan.log]
    return spark.createDataFrame(
        rows, "table_name string, column_name string, outlier_count bigint, method string, action string"
    )


# ---------------------------------------------------------------- features

PRIORITIES = Derived("orders", ["o_orderkey", "o_totalprice", gap("o_orderkey % 11 = 0", "o_orderpriority")])
ONE_HOT_NAMES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "encode_onehot",
    "SELECT o_orderkey, o_totalprice, "
    + ", ".join(f"coalesce(o_orderpriority = '{v}', false) AS \"o_orderpriority_{v}\"" for v in ONE_HOT_NAMES)
    + f" FROM ({PRIORITIES.sql})",
)
def encode_onehot(spark, sf_dir):
    return feats.encode_one_hot(PRIORITIES.frame(spark, sf_dir), "o_orderpriority")


SOURCES = Derived("documents", ["doc_id", gap("doc_id % 9 = 0", "source")])


@query("encode_label", f"SELECT doc_id, dense_rank() OVER (ORDER BY coalesce(source, 'nan')) - 1 AS source FROM ({SOURCES.sql})")
def encode_label(spark, sf_dir):
    return feats.encode_labels(SOURCES.frame(spark, sf_dir), "source")


@query(
    "encode_label_wide",
    "SELECT doc_id, lang, dense_rank() OVER (ORDER BY text) - 1 AS text FROM documents",
)
def encode_label_wide(spark, sf_dir):
    # The route for dictionaries too large to broadcast, taken here whatever the size.
    return feats.encode_labels(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "text", small=0)


@query(
    "encode_label_many",
    "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS o_orderstatus, "
    "dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority, "
    "dense_rank() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) - 1 AS customer, "
    "dense_rank() OVER (ORDER BY strftime(o_orderdate, '%Y-%m-%d')) - 1 AS day FROM orders",
)
def encode_label_many(spark, sf_dir):
    # Four columns on the route for large dictionaries, hot values among them; the table is read once.
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_orderstatus", "o_orderpriority", "CAST(o_custkey AS STRING) AS customer",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS day",
    )
    return feats.encode_labels(orders, ["o_orderstatus", "o_orderpriority", "customer", "day"], small=0)


@query(
    "forward_fill_long_keys",
    "SELECT doc_id, last_value(n_chars IGNORE NULLS) OVER (ORDER BY k, doc_id) AS n_chars FROM (SELECT doc_id, "
    "repeat('same start ', 40) || text AS k, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE n_chars END AS n_chars FROM documents)",
)
def forward_fill_long_keys(spark, sf_dir):
    # Keys that differ only after hundreds of characters still spread over many ranges.
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "concat(repeat('same start ', 40), text) AS k", gap("doc_id % 4 = 0", "n_chars")
    )
    return forward_fill(docs, ["n_chars"], ["k", "doc_id"], rows_per_range=100).select("doc_id", "n_chars")


@query(
    "scale_standard",
    "SELECT event_id, round((value - m) / s, 6) AS value FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)",
)
def scale_standard(spark, sf_dir):
    return rounded(feats.scale(table(spark, sf_dir, "events").select("event_id", "value"), "value", "standard"), "value")


@query(
    "scale_minmax",
    "SELECT p_partkey, round((p_size - lo) * 1.0::DOUBLE / (hi - lo), 6) AS p_size, 0.0::DOUBLE AS flat FROM part, "
    "(SELECT min(p_size) AS lo, max(p_size) AS hi FROM part)",
)
def scale_minmax(spark, sf_dir):
    df = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size", "CAST(3 AS BIGINT) AS flat")
    return rounded(feats.scale(feats.scale(df, "p_size", "min-max"), "flat", "min-max"), "p_size")


@query(
    "cut_buckets",
    "SELECT p_partkey, p_size, CASE WHEN p_size > 0 AND p_size <= 18 THEN 'Young' WHEN p_size > 18 AND p_size <= 35 THEN 'Adult' "
    "WHEN p_size > 35 AND p_size <= 50 THEN 'Middle' WHEN p_size > 50 AND p_size <= 100 THEN 'Senior' END AS bucket FROM part",
)
def cut_buckets(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return df.withColumn("bucket", cut(F.col("p_size"), feats.AGE_BINS, feats.AGE_LABELS))


DERIVED_SPECS = {
    "new_features": [
        {"name": "AgeGroup", "description": "Categorize age into groups", "reason": "Improves model interpretability"},
        {"name": "Ratio", "description": "Price per unit"},
    ]
}
PEOPLE = Derived("part", ["p_partkey", "p_size * 2 AS \"Age\"", "p_brand", "p_type", "p_retailprice"])
PEOPLE_SPARK = ["p_partkey", "p_size * 2 AS Age", "p_brand", "p_type", "p_retailprice"]


@query(
    "derived_features",
    "SELECT p_partkey, \"Age\", p_brand, p_type, p_retailprice, CASE WHEN \"Age\" <= 0 THEN NULL WHEN \"Age\" <= 18 THEN 'Young' "
    "WHEN \"Age\" <= 35 THEN 'Adult' WHEN \"Age\" <= 50 THEN 'Middle' WHEN \"Age\" <= 100 THEN 'Senior' END AS \"AgeGroup\" "
    f"FROM ({PEOPLE.sql})",
)
def derived_features(spark, sf_dir):
    return engineer(table(spark, sf_dir, "part").selectExpr(*PEOPLE_SPARK), advice=DERIVED_SPECS)[0]


SUGGESTED = Derived("documents", ["doc_id", "text", "lang", "source", "n_chars", "CAST(1 AS BIGINT) AS one"])
SUGGESTED_TEXTS, SUGGESTED_NUMBERS = ["text", "lang", "source"], ["doc_id", "n_chars", "one"]


@query(
    "feature_suggestions",
    f"WITH d AS ({SUGGESTED.sql}) "
    + union_all(
        [
            f"SELECT 'encoding' AS list, '{c}' AS column_name, CASE WHEN k <= 10 THEN 'one-hot' ELSE 'label' END AS method, "
            f"CASE WHEN k <= 10 THEN 'Low cardinality' ELSE 'High cardinality' END AS reason FROM (SELECT count(DISTINCT {c}) AS k FROM d)"
            for c in SUGGESTED_TEXTS
        ]
        + [
            f"SELECT 'scaling', '{c}', 'standard', 'High variance' FROM (SELECT stddev_samp({c}) AS s, avg({c}) AS m FROM d) "
            "WHERE s > 0 AND m <> 0 AND s / abs(m) > 1"
            for c in SUGGESTED_NUMBERS
        ]
        + [
            f"SELECT 'drop', '{c}', NULL::VARCHAR, CASE WHEN k <= 1 THEN 'Constant column' ELSE 'Unique identifier' END "
            f"FROM (SELECT count(DISTINCT {c}) AS k, count(*) AS n FROM d) WHERE k <= 1 OR k = n"
            for c in SUGGESTED_TEXTS + SUGGESTED_NUMBERS
        ]
    ),
)
def feature_suggestions(spark, sf_dir):
    found = decide.feature_suggestions(profile_features(SUGGESTED.frame(spark, sf_dir)))
    rows = [
        (name, spec["column"], spec.get("method"), spec["reason"])
        for name in ("encoding", "scaling", "drop")
        for spec in getattr(found, name)
    ]
    return spark.createDataFrame(rows, "list string, column_name string, method string, reason string")


@query(
    "feature_pipeline",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, "
    + ", ".join(f"l_returnflag = '{v}' AS \"l_returnflag_{v}\"" for v in "ANR")
    + ", "
    + ", ".join(f"l_linestatus = '{v}' AS \"l_linestatus_{v}\"" for v in "FO")
    + " FROM lineitem",
)
def feature_pipeline(spark, sf_dir):
    return engineer(table(spark, sf_dir, "lineitem"))[0]


@query(
    "feature_pipeline_full",
    f"WITH d AS ({SUGGESTED.sql}) SELECT dense_rank() OVER (ORDER BY text) - 1 AS text, dense_rank() OVER (ORDER BY source) - 1 AS source, "
    "round((n_chars - (SELECT avg(n_chars) FROM d)) / (SELECT stddev_pop(n_chars) FROM d), 6) AS n_chars, "
    + ", ".join(f"lang = '{v}' AS lang_{v}" for v in ("de", "en", "es", "fr"))
    + " FROM d",
)
def feature_pipeline_full(spark, sf_dir):
    return rounded(engineer(SUGGESTED.frame(spark, sf_dir), scaling=True, dropping=True)[0], "n_chars")


@query(
    "feature_log",
    f"WITH d AS ({SUGGESTED.sql}) SELECT row_number() OVER (ORDER BY part, position) - 1 AS seq, action, details FROM ("
    + union_all(
        [
            f"SELECT 1 AS part, {i} AS position, CASE WHEN k <= 10 THEN 'Encoded ''{c}'' (one-hot)' ELSE 'Encoded ''{c}'' (label)' END AS action, "
            f"CASE WHEN k <= 10 THEN 'Low cardinality' ELSE 'High cardinality' END AS details FROM (SELECT count(DISTINCT {c}) AS k FROM d)"
            for i, c in enumerate(SUGGESTED_TEXTS)
        ]
        + [
            f"SELECT 2, {i}, 'Suggested: scale ''{c}'' (standard)', 'High variance' FROM (SELECT stddev_samp({c}) AS s, avg({c}) AS m FROM d) "
            "WHERE s > 0 AND m <> 0 AND s / abs(m) > 1"
            for i, c in enumerate(SUGGESTED_NUMBERS)
        ]
        + [
            f"SELECT 3, {i}, 'Suggested: drop ''{c}''', CASE WHEN k <= 1 THEN 'Constant column' ELSE 'Unique identifier' END "
            f"FROM (SELECT count(DISTINCT {c}) AS k, count(*) AS n FROM d) WHERE (k <= 1 OR k = n){' AND k > 10' if c in SUGGESTED_TEXTS else ''}"
            for i, c in enumerate(["doc_id", "text", "lang", "source", "n_chars", "one"])
        ]
    )
    + ")",
)
def feature_log(spark, sf_dir):
    log = plan_features(SUGGESTED.frame(spark, sf_dir)).log_frame(spark)
    return log.withColumn("seq", F.col("seq").cast("bigint"))


# Fitted on the orders with a price gap, applied to all orders.
FIT = Derived(
    "orders",
    ["o_orderkey", "o_totalprice", "o_orderstatus", "CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS o_orderpriority"],
)


@query(
    "apply_fitted",
    f"WITH d AS ({FIT.sql}), codes AS (SELECT o_orderstatus AS status, row_number() OVER (ORDER BY o_orderstatus) - 1 AS code FROM "
    "(SELECT DISTINCT o_orderstatus FROM d)) SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM d)) / "
    "(SELECT stddev_pop(o_totalprice) FROM d), 6) AS o_totalprice, code AS o_orderstatus, "
    + ", ".join(f"o_orderpriority = '{v}' AS \"o_orderpriority_{v}\"" for v in ONE_HOT_NAMES)
    + " FROM orders LEFT JOIN codes ON o_orderstatus = status",
)
def apply_fitted(spark, sf_dir):
    fit_on = FIT.frame(spark, sf_dir)
    features = feats.FeaturePlan(
        one_hot=feats.fit_one_hot(fit_on, ["o_orderpriority"]),
        labels=feats.fit_labels(fit_on, ["o_orderstatus"]),
        scales=feats.fit_scales(fit_on, {"o_totalprice": "standard"}),
    )
    # through storage, as another application would get it
    plan = load_plan(spark, save_plan(spark, PreparationPlan(features=features), scratch_path(spark, "plan")))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    return rounded(plan.apply(orders), "o_totalprice")


# ---------------------------------------------------------------- whole chain

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "prepare_events",
    CLEANED
    + f" SELECT event_id, ts, round({_capped('value', 'cleaned')}, 6) AS value, dense_rank() OVER (ORDER BY props) - 1 AS props, user_ref, "
    + ", ".join(f"event_type = '{v}' AS event_type_{v}" for v in EVENT_TYPES)
    + " FROM cleaned",
)
def prepare_events(spark, sf_dir):
    return rounded(prepare(GAPPY.frame(spark, sf_dir)).df, "value")


@query("prepare_registry", f"SELECT 'events' AS id, 'completed' AS status, (SELECT count(*) FROM events) AS rows, {4 + len(EVENT_TYPES) + 1} AS columns")
def prepare_registry(spark, sf_dir):
    return registry_row(prepare(GAPPY.frame(spark, sf_dir), charts=False), "events")


@query(
    "feature_roles",
    "WITH c AS (SELECT * FROM (VALUES (0, 'event_id'), (1, 'ts'), (2, 'value'), (3, 'props'), (4, 'user_ref')) AS v(position, column_name) "
    "UNION ALL SELECT 4 + row_number() OVER (ORDER BY event_type), 'event_type_' || event_type FROM (SELECT DISTINCT event_type FROM events WHERE event_id % 3 <> 0)) "
    "SELECT position, column_name, CASE WHEN regexp_matches(lower(column_name), 'target|label|y|output|class') THEN 'output' ELSE 'input' END AS role FROM c",
)
def feature_roles(spark, sf_dir):
    prepared = prepare(GAPPY.frame(spark, sf_dir), charts=False).df
    rows = [(i, name, role) for i, (name, role) in enumerate(decide.feature_roles(prepared.columns))]
    return spark.createDataFrame(rows, "position bigint, column_name string, role string")
