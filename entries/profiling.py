"""Profiles, rankings and chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries.common import (
    GAPPY,
    GAPPY_NUMBERS,
    GAPPY_TEXTS,
    GAPPY_TYPES,
    Derived,
    query,
    rounded,
    sql_fences,
    sql_mode,
    table,
    union_all,
)
from tableprep.functions.types import kind_of, nan_to_null
from tableprep.operators import eda as charts
from tableprep.operators import frequencies
from tableprep.operators.clean import profile_missing
from tableprep.operators.profile import profile
from tableprep.plans import decide

D = f"WITH d AS ({GAPPY.sql})\n"


@query(
    "null_profile",
    D
    + union_all(
        [
            f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, "
            f"round((count(*) - count({c})) * 1.0::DOUBLE / count(*), 6) AS null_pct FROM d"
            for c in GAPPY_TYPES
        ]
    ),
)
def null_profile(spark, sf_dir):
    stats = profile(GAPPY.frame(spark, sf_dir), quartiles=())
    rows = [(s.name, s.nulls, round(s.null_share, 6)) for s in stats]
    return spark.createDataFrame(rows, "column_name string, null_count bigint, null_pct double")


@query(
    "null_ranking",
    D
    + "SELECT column_name, null_count, row_number() OVER (ORDER BY null_count DESC, position) AS null_rank FROM ("
    + union_all(
        [
            f"SELECT {i} AS position, '{c}' AS column_name, count(*) - count({c}) AS null_count FROM d"
            for i, c in enumerate(GAPPY_TYPES)
        ]
    )
    + ") WHERE null_count > 0",
)
def null_ranking(spark, sf_dir):
    ranked = decide.null_ranking(profile(GAPPY.frame(spark, sf_dir), quartiles=()))
    rows = [(s.name, s.nulls, i + 1) for i, s in enumerate(ranked)]
    return spark.createDataFrame(rows, "column_name string, null_count bigint, null_rank bigint")


@query(
    "distinct_profile",
    union_all(
        [
            f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values FROM lineitem"
            for c in (
                "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
                "l_returnflag l_linestatus l_shipdate"
            ).split()
        ]
        + [
            f"SELECT 'doc_{c}' AS column_name, count(DISTINCT {c}) AS distinct_values FROM documents"
            for c in ("text", "lang", "source")
        ]
    ),
)
def distinct_profile(spark, sf_dir):
    lines = profile(table(spark, sf_dir, "lineitem"), quartiles=(), distinct=None)
    texts = profile(table(spark, sf_dir, "documents"), ["text", "lang", "source"], distinct=None)
    rows = [(s.name, s.distinct) for s in lines] + [(f"doc_{s.name}", s.distinct) for s in texts]
    return spark.createDataFrame(rows, "column_name string, distinct_values bigint")


LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "numeric_profile",
    union_all(
        [
            f"SELECT '{c}' AS column_name, min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value, "
            f"round(avg({c}), 4) AS mean_value, round(median({c})::DOUBLE, 6) AS median_value, "
            f"round(stddev_samp({c}), 4) AS std_value FROM lineitem"
            for c in LINE_NUMBERS
        ]
    ),
)
def numeric_profile(spark, sf_dir):
    rows = [
        (s.name, float(s.low), float(s.high), s.mean, s.median, s.std)
        for s in profile(table(spark, sf_dir, "lineitem"), LINE_NUMBERS)
    ]
    out = spark.createDataFrame(
        rows,
        "column_name string, min_value double, max_value double, mean_value double, median_value double, "
        "std_value double",
    )
    return rounded(rounded(out, "mean_value", "std_value", digits=4), "median_value")


@query(
    "iqr_profile",
    union_all(
        [
            f"SELECT '{c}' AS column_name, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, "
            f"round(hi - lo, 6) AS value_range, round((q3 - q1) / (hi - lo), 6) AS iqr_share FROM "
            f"(SELECT quantile_cont({c}, 0.25)::DOUBLE AS q1, quantile_cont({c}, 0.75)::DOUBLE AS q3, "
            f"max({c})::DOUBLE AS hi, min({c})::DOUBLE AS lo FROM {t})"
            for t, c in [("events", "value"), ("orders", "o_totalprice"), ("documents", "n_chars"), ("part", "p_size")]
        ]
    ),
)
def iqr_profile(spark, sf_dir):
    rows = []
    for t, c in [("events", "value"), ("orders", "o_totalprice"), ("documents", "n_chars"), ("part", "p_size")]:
        s = profile(table(spark, sf_dir, t), [c])[c]
        spread = float(s.high) - float(s.low)
        rows.append((c, s.q1, s.q3, s.iqr, spread, s.iqr / spread))
    out = spark.createDataFrame(
        rows, "column_name string, q1 double, q3 double, iqr double, value_range double, iqr_share double"
    )
    return rounded(out, "q1", "q3", "iqr", "value_range", "iqr_share")


MODE_COLUMNS = ["event_type", "props", "value", "user_ref", "ts"]


@query(
    "mode_profile",
    D
    + union_all(
        [
            f"SELECT '{c}' AS column_name, {sql_mode(c, 'd')}::VARCHAR AS mode_value, "
            f"(SELECT max(n) FROM (SELECT count(*) AS n FROM d WHERE {c} IS NOT NULL GROUP BY {c})) AS copies"
            for c in MODE_COLUMNS
        ]
    ),
)
def mode_profile(spark, sf_dir):
    top = frequencies.top_values(GAPPY.frame(spark, sf_dir), MODE_COLUMNS, 1)
    return top.select(F.col("column").alias("column_name"), F.col("value").alias("mode_value"), F.col("n").alias("copies"))


def _stats_sql(c: str) -> str:
    if c in GAPPY_NUMBERS:
        numbers = (
            f"min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value, round(avg({c}), 6) AS mean_value, "
            f"round(median({c})::DOUBLE, 6) AS median_value, round(stddev_samp({c}), 6) AS std_value, "
            "NULL::VARCHAR AS mode_value"
        )
    else:
        mode = sql_mode(c, "d") if c in GAPPY_TEXTS else "NULL::VARCHAR"
        numbers = (
            "NULL::DOUBLE AS min_value, NULL::DOUBLE AS max_value, NULL::DOUBLE AS mean_value, "
            f"NULL::DOUBLE AS median_value, NULL::DOUBLE AS std_value, {mode} AS mode_value"
        )
    return (
        f"SELECT '{c}' AS column_name, '{GAPPY_TYPES[c]}' AS dtype, count(*) - count({c}) AS null_count, "
        f"count(DISTINCT {c}) AS unique_count, {numbers} FROM d"
    )


@query("column_stats", D + union_all([_stats_sql(c) for c in GAPPY_TYPES]))
def column_stats(spark, sf_dir):
    stats = profile(GAPPY.frame(spark, sf_dir), distinct=None, modes=GAPPY_TEXTS)
    rows = [
        (
            s.name,
            s.dtype,
            s.nulls,
            s.distinct,
            *[None if v is None else float(v) for v in (s.low, s.high, s.mean, s.median, s.std)],
            s.mode,
        )
        for s in stats
    ]
    out = spark.createDataFrame(
        rows,
        "column_name string, dtype string, null_count bigint, unique_count bigint, min_value double, "
        "max_value double, mean_value double, median_value double, std_value double, mode_value string",
    )
    return rounded(out, "mean_value", "median_value", "std_value")


def _describe_sql(source: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        for stat, expr in {
            "count": f"count({c})",
            "mean": f"avg({c})",
            "std": f"stddev_samp({c})",
            "min": f"min({c})",
            "25%": f"quantile_cont({c}, 0.25)",
            "50%": f"quantile_cont({c}, 0.5)",
            "75%": f"quantile_cont({c}, 0.75)",
            "max": f"max({c})",
        }.items():
            parts.append(f"SELECT '{c}' AS column_name, '{stat}' AS stat, round(({expr})::DOUBLE, 4) AS value FROM {source}")
    return union_all(parts)


def _dates_sql(table_name: str, column: str) -> str:
    at = f"epoch_us({column}) / 1e6"
    facts = {
        "mean": f"avg({at})", "min": f"min({at})", "25%": f"quantile_cont({at}, 0.25)", "50%": f"quantile_cont({at}, 0.5)",
        "75%": f"quantile_cont({at}, 0.75)", "max": f"max({at})",
    }
    rows = [f"SELECT '{column}' AS column_name, 'count' AS stat, count({column}) AS n, NULL::TIMESTAMP AS value FROM {table_name}"]
    rows += [
        f"SELECT '{column}', '{stat}', NULL, TIMESTAMP '1970-01-01' + to_seconds(round_even({e}, 0)::BIGINT) FROM {table_name}"
        for stat, e in facts.items()
    ]
    return union_all(rows)


@query("describe_dates", union_all([_dates_sql("events", "ts"), _dates_sql("orders", "o_orderdate")]))
def describe_dates(spark, sf_dir):
    parts = [charts.describe_dates(table(spark, sf_dir, name)) for name in ("events", "orders")]
    return parts[0].unionAll(parts[1]).withColumnRenamed("column", "column_name")


@query("describe", D + _describe_sql("d", GAPPY_NUMBERS))
def describe(spark, sf_dir):
    df = GAPPY.frame(spark, sf_dir)
    out = charts.describe(df, profile(df)).withColumnRenamed("column", "column_name")
    return rounded(out, "value", digits=4)


@query(
    "table_summary",
    D
    + union_all(
        [
            f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS dtype, "
            f"'{'number' if c in GAPPY_NUMBERS else 'string' if c in GAPPY_TEXTS else 'datetime'}' AS kind, "
            f"count(*) AS row_count, {len(GAPPY_TYPES)} AS column_count, count(*) - count({c}) AS missing, "
            f"count(DISTINCT {c}) AS distinct_values FROM d"
            for i, (c, t) in enumerate(GAPPY_TYPES.items())
        ]
    ),
)
def table_summary(spark, sf_dir):
    df = GAPPY.frame(spark, sf_dir)
    out = charts.summary(df, profile(df, quartiles=(), distinct=None))
    return out.withColumnsRenamed({"column": "column_name", "rows": "row_count", "columns": "column_count"})


INVENTORY = {
    "lineitem": [
        ("l_orderkey", "bigint", "number"),
        ("l_partkey", "bigint", "number"),
        ("l_suppkey", "bigint", "number"),
        ("l_linenumber", "int", "number"),
        ("l_quantity", "double", "number"),
        ("l_extendedprice", "double", "number"),
        ("l_discount", "double", "number"),
        ("l_tax", "double", "number"),
        ("l_returnflag", "string", "string"),
        ("l_linestatus", "string", "string"),
        ("l_shipdate", "timestamp_ntz", "datetime"),
    ],
    "embeddings": [
        ("vec_id", "bigint", "number"),
        ("embedding", "array<float>", "other"),
        ("label", "int", "number"),
    ],
}


@query(
    "dtype_inventory",
    union_all(
        [
            f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{d}' AS dtype, '{k}' AS kind, count({c}) AS filled FROM {t}"
            for t, columns in INVENTORY.items()
            for c, d, k in columns
        ]
    ),
)
def dtype_inventory(spark, sf_dir):
    rows = []
    for name in INVENTORY:
        df = table(spark, sf_dir, name)
        stats = profile(df, quartiles=())
        rows += [(name, f.name, f.dataType.simpleString(), kind_of(f.dataType), stats[f.name].filled) for f in df.schema]
    return spark.createDataFrame(rows, "table_name string, column_name string, dtype string, kind string, filled bigint")


CATEGORY_TABLES = {
    "events": ["event_type", "props"],
    "documents": ["text", "lang", "source"],
    "part": ["p_name", "p_brand", "p_type"],
    "lineitem": ["l_returnflag", "l_linestatus"],
}


@query(
    "useful_categoricals",
    "SELECT table_name, column_name, distinct_values, seq FROM (SELECT *, row_number() OVER "
    "(PARTITION BY table_name ORDER BY position) AS seq FROM ("
    + union_all(
        [
            f"SELECT '{t}' AS table_name, '{c}' AS column_name, {i} AS position, count(DISTINCT {c}) AS distinct_values FROM {t}"
            for t, columns in CATEGORY_TABLES.items()
            for i, c in enumerate(columns)
        ]
    )
    + ") WHERE distinct_values > 1 AND distinct_values <= 50) WHERE seq <= 5",
)
def useful_categoricals(spark, sf_dir):
    rows = []
    for name, columns in CATEGORY_TABLES.items():
        found = decide.useful_categories(profile(table(spark, sf_dir, name), columns, distinct=None, screen=True))
        rows += [(name, s.name, s.distinct, i + 1) for i, s in enumerate(found)]
    return spark.createDataFrame(rows, "table_name string, column_name string, distinct_values bigint, seq bigint")


@query(
    "top_variance_columns",
    "SELECT column_name, round(variance, 2) AS variance, row_number() OVER (ORDER BY variance DESC) AS seq FROM ("
    + union_all([f"SELECT '{c}' AS column_name, var_samp({c}) AS variance FROM lineitem" for c in LINE_NUMBERS])
    + ") ORDER BY seq LIMIT 5",
)
def top_variance_columns(spark, sf_dir):
    found = decide.top_variance(profile(table(spark, sf_dir, "lineitem"), quartiles=()))
    rows = [(s.name, s.variance, i + 1) for i, s in enumerate(found)]
    out = spark.createDataFrame(rows, "column_name string, variance double, seq bigint")
    return rounded(out, "variance", digits=2)


@query("sample_head", f"SELECT event_id, event_type, value, props FROM ({GAPPY.sql}) ORDER BY ts, event_id LIMIT 10")
def sample_head(spark, sf_dir):
    return charts.head(GAPPY.frame(spark, sf_dir), 10, ["ts", "event_id"]).select("event_id", "event_type", "value", "props")


ORDER_OTHERS = ["o_orderstatus", "o_orderdate", "o_orderpriority"]


@query(
    "sample_statistics",
    union_all(
        [
            f"SELECT '{c}' AS column_name, '{stat}' AS stat, NULL::VARCHAR AS item, round(({f}({c}))::DOUBLE, 4) AS value FROM orders"
            for c in ("o_orderkey", "o_custkey", "o_totalprice")
            for stat, f in {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}.items()
        ]
        + [
            f"SELECT '{c}' AS column_name, 'unique_count' AS stat, NULL::VARCHAR AS item, count(DISTINCT {c})::DOUBLE AS value FROM orders"
            for c in ORDER_OTHERS
        ]
        + [
            f"(SELECT '{c}' AS column_name, 'top' AS stat, {c}::VARCHAR AS item, count(*)::DOUBLE AS value FROM orders "
            f"GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 5)"
            for c in ORDER_OTHERS
        ]
    ),
)
def sample_statistics(spark, sf_dir):
    out = charts.sample_statistics(table(spark, sf_dir, "orders")).withColumnRenamed("column", "column_name")
    return rounded(out, "value", digits=4)


def _top_sql(source: str, columns: list[str], k: int) -> str:
    return union_all(
        [
            f"SELECT '{c}' AS column_name, value, n, value_rank FROM (SELECT {c}::VARCHAR AS value, count(*) AS n, "
            f"row_number() OVER (ORDER BY count(*) DESC, {c}) AS value_rank FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}) "
            f"WHERE value_rank <= {k}"
            for c in columns
        ]
    )


@query("top_values", D + _top_sql("d", ["event_type", "props", "user_ref"], 5))
def top_values(spark, sf_dir):
    out = frequencies.top_values(GAPPY.frame(spark, sf_dir), ["event_type", "props", "user_ref"], 5)
    return out.select(
        F.col("column").alias("column_name"), "value", "n", F.col("rank").cast("bigint").alias("value_rank")
    )


@query("count_plot", _top_sql("documents", ["lang", "source"], 20) + "\nUNION ALL\n" + _top_sql("part", ["p_brand", "p_type"], 20))
def count_plot(spark, sf_dir):
    out = charts.count_plot(table(spark, sf_dir, "documents"), ["lang", "source"]).unionAll(
        charts.count_plot(table(spark, sf_dir, "part"), ["p_brand", "p_type"])
    )
    return out.select(
        F.col("column").alias("column_name"), "value", "n", F.col("rank").cast("bigint").alias("value_rank")
    )


HISTOGRAM_COLUMNS = ["value", "user_ref", "constant"]


def _histogram_sql(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, bin, round(edges[bin + 1], 6) AS low, round(edges[bin + 2], 6) AS high, count(x) AS n
FROM (SELECT b.bin, e.edges, v.x FROM range(30) AS b(bin)
CROSS JOIN (SELECT list_append([lo + i * ((hi - lo) / 30) FOR i IN range(30)], hi) AS edges FROM bounds_{c}) e
LEFT JOIN (SELECT x, CASE WHEN x < edges[g + 1] THEN g - 1 WHEN g < 29 AND x >= edges[g + 2] THEN g + 1 ELSE g END AS bin
FROM (SELECT x, edges, least(floor((x - lo) / (hi - lo) * 30)::INT, 29) AS g FROM (SELECT {c}::DOUBLE AS x FROM d WHERE {c} IS NOT NULL),
(SELECT lo, hi, list_append([lo + i * ((hi - lo) / 30) FOR i IN range(30)], hi) AS edges FROM bounds_{c}))) v ON v.bin = b.bin)
GROUP BY bin, edges"""


@query(
    "histogram",
    f"WITH d AS ({GAPPY.sql}), "
    + ", ".join(
        f"bounds_{c} AS (SELECT CASE WHEN a = b THEN a - 0.5 ELSE a END AS lo, CASE WHEN a = b THEN b + 0.5 ELSE b END AS hi "
        f"FROM (SELECT min({c})::DOUBLE AS a, max({c})::DOUBLE AS b FROM d))"
        for c in HISTOGRAM_COLUMNS
    )
    + "\n"
    + union_all([_histogram_sql(c) for c in HISTOGRAM_COLUMNS]),
)
def histogram(spark, sf_dir):
    df = GAPPY.frame(spark, sf_dir)
    out = charts.histogram(df, list(profile(df, HISTOGRAM_COLUMNS, quartiles=())))
    out = out.select(F.col("column").alias("column_name"), F.col("bin").cast("bigint").alias("bin"), "low", "high", "n")
    return rounded(out, "low", "high")


BOX_COLUMNS = [("d", "value"), ("d", "user_ref"), ("d", "constant")]


@query(
    "boxplot_stats",
    D
    + union_all(
        [
            f"""SELECT '{c}' AS column_name, round(least(coalesce(w.lo, f.q1), f.q1), 6) AS whisker_low, round(f.q1, 6) AS q1,
round(f.med, 6) AS median, round(f.q3, 6) AS q3, round(greatest(coalesce(w.hi, f.q3), f.q3), 6) AS whisker_high, w.fliers
FROM (SELECT q1, q3, lo, hi, (SELECT median({c}) FROM {t})::DOUBLE AS med FROM {sql_fences(c, t)}) f,
(SELECT min({c}) FILTER ({c} >= lo)::DOUBLE AS lo, max({c}) FILTER ({c} <= hi)::DOUBLE AS hi,
count(*) FILTER ({c} < lo OR {c} > hi) AS fliers FROM {t}, {sql_fences(c, t)} g) w"""
            for t, c in BOX_COLUMNS
        ]
    ),
)
def boxplot_stats(spark, sf_dir):
    df = GAPPY.frame(spark, sf_dir)
    out = charts.boxplot(df, list(profile(df, [c for _, c in BOX_COLUMNS]))).withColumnRenamed("column", "column_name")
    return rounded(out, "whisker_low", "q1", "median", "q3", "whisker_high")


FLAT_LINES = Derived("lineitem", [*LINE_NUMBERS, "CAST(1.0 AS DOUBLE) AS flat", "l_quantity * l_extendedprice AS value"])


@query(
    "correlation_matrix",
    "SELECT x, y, round(r, 4) AS r FROM ("
    + union_all(
        [
            f"SELECT '{a}' AS x, '{b}' AS y, "
            + (
                "NULL::DOUBLE AS r"
                if "flat" in (a, b)
                else f"(SELECT corr({a}, {b}) FROM ({FLAT_LINES.sql})) AS r"
            )
            for a in [*LINE_NUMBERS, "flat", "value"]
            for b in [*LINE_NUMBERS, "flat", "value"]
        ]
    )
    + ")",
)
def correlation_matrix(spark, sf_dir):
    return rounded(charts.correlation(FLAT_LINES.frame(spark, sf_dir)), "r", digits=4)


@query(
    "correlation_gaps",
    D
    + union_all(
        [
            f"SELECT '{a}' AS x, '{b}' AS y, round((SELECT corr({a}, {b}) FROM d), 4) AS r"
            for a in ("event_id", "value", "user_ref")
            for b in ("event_id", "value", "user_ref")
        ]
    ),
)
def correlation_gaps(spark, sf_dir):
    out = charts.correlation(GAPPY.frame(spark, sf_dir).select("event_id", "value", "user_ref"))
    return rounded(out, "r", digits=4)


@query(
    "eda_manifest",
    """WITH v AS ("""
    + union_all(
        [
            f"SELECT '{c}' AS column_name, {i} AS position, var_samp({c}) AS variance FROM documents"
            for i, c in enumerate(["doc_id", "n_chars"])
        ]
    )
    + """), numbers AS (SELECT column_name, row_number() OVER (ORDER BY variance DESC, position) AS seq FROM v),
c AS ("""
    + union_all(
        [
            f"SELECT '{c}' AS column_name, {i} AS position, count(DISTINCT {c}) AS n FROM documents"
            for i, c in enumerate(["text", "lang", "source"])
        ]
    )
    + """), charts AS (SELECT 'histogram' AS type, column_name, seq * 2 AS place FROM numbers WHERE seq <= 5
UNION ALL SELECT 'boxplot', column_name, seq * 2 + 1 FROM numbers WHERE seq <= 5
UNION ALL SELECT 'heatmap', NULL, 100
UNION ALL SELECT 'countplot', column_name, 200 + row_number() OVER (ORDER BY position) FROM c WHERE n > 1 AND n <= 50)
SELECT row_number() OVER (ORDER BY place) - 1 AS seq, type, column_name FROM charts""",
)
def eda_manifest(spark, sf_dir):
    df = nan_to_null(table(spark, sf_dir, "documents"))
    stats = profile(df, quartiles=(), distinct=None, screen=True)
    rows = [(i, kind, column) for i, (kind, column) in enumerate(charts.chart_list(stats))]
    return spark.createDataFrame(rows, "seq bigint, type string, column_name string")


@query(
    "null_strategy",
    D
    + union_all(
        [
            f"SELECT '{c}' AS column_name, CASE WHEN share > 0.8 THEN 'drop_column' "
            f"WHEN coalesce(sd, 0) = 0 THEN 'drop_column' WHEN spread > 0 AND iqr / spread < 0.3 THEN 'median' ELSE 'mean' END AS action "
            f"FROM (SELECT (count(*) - count({c})) * 1.0 / count(*) AS share, stddev_samp({c}) AS sd, max({c}) - min({c}) AS spread, "
            f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr FROM {t}) WHERE share > 0"
            for c, t in [
                ("value", "d"),
                ("mostly_missing", "d"),
                ("constant", "d"),
                ("user_ref", "d"),
                ("o_totalprice", "(SELECT CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS o_totalprice FROM orders)"),
            ]
        ]
        + [
            f"SELECT '{c}' AS column_name, CASE WHEN share > 0.8 THEN 'drop_column' WHEN n * 1.0 / total > 0.5 THEN 'unknown' ELSE 'mode' END AS action "
            f"FROM (SELECT (count(*) - count({c})) * 1.0 / count(*) AS share, count(DISTINCT {c}) AS n, count(*) AS total FROM {t}) WHERE share > 0"
            for c, t in [
                ("event_type", "d"),
                ("props", "d"),
                ("c_name", "(SELECT CASE WHEN c_custkey % 8 <> 0 THEN c_name END AS c_name FROM customer)"),
            ]
        ]
    ),
)
def null_strategy(spark, sf_dir):
    frames = [
        GAPPY.frame(spark, sf_dir),
        table(spark, sf_dir, "orders").selectExpr("CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS o_totalprice"),
        table(spark, sf_dir, "customer").selectExpr("CASE WHEN c_custkey % 8 <> 0 THEN c_name END AS c_name"),
    ]
    rows = []
    for df in frames:
        rows += [(s.name, d.action) for s, d in decide.choose_strategies(profile_missing(df), "fast", {})]
    return spark.createDataFrame(rows, "column_name string, action string")
