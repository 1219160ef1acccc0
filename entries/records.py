"""Sources and sinks, registry questions, advice answers, request rates and streams."""

from __future__ import annotations

import math

import entries.cleaning  # noqa: F401 - registers the twin of the streamed preparation
import pyarrow as pa
from pyspark.sql import functions as F

from entries.common import GAPPY, ORACLES, query, rounded, table, union_all
from tableprep.operators import advice, rate
from tableprep.operators.clean import clean, plan_cleaning
from tableprep.operators.outliers import plan_outliers
from tableprep.plans.prepare import prepare, prepare_dataset
from tableprep.session import scratch_path
from tableprep.sources import registry
from tableprep.sources.synth import synth_columns
from tableprep.sources.tables import (
    dataset_name,
    location,
    read_any,
    read_csv,
    read_json,
    read_table,
    table_shape,
    write_table,
)
from tableprep.sources.tables import validate_shape as check_shape
from tableprep.streaming.apply import apply_to_stream, file_stream, intake, intake_datasets, write_stream
from tableprep.streaming.rate import ROCKSDB, admit_stream, rate_windows

# ---------------------------------------------------------------- sources and sinks

FILE_BYTES = 256 << 20  # texts of one written file, about; more than a split


def in_large_files(df, size):
    """The rows in files of about ``FILE_BYTES``, so one file where they are few; ``size`` is the bytes of a row."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return df.coalesce(max(1, math.ceil(total / FILE_BYTES)))


def as_array(batches):
    """The elements of a part as the lines of one JSON array."""
    before = "["
    for batch in batches:
        lines = []
        for item in batch.column(0).to_pylist():
            lines.append(before + item)
            before = ","
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["line"])
    yield pa.RecordBatch.from_arrays([pa.array(["]" if before == "," else "[]"])], names=["line"])


TOKENS = ["''", "'NA'", "'N/A'", "'NaN'", "'null'", "'None'", "'#N/A'", "'<NA>'"]
_TOKEN = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(TOKENS)) + " END"


@query(
    "read_csv_na",
    "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, "
    "CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS user_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS props, "
    "event_id % 2 = 0 AS even, NULL::DOUBLE AS nothing FROM events",
)
def read_csv_na(spark, sf_dir):
    texts = table(spark, sf_dir, "events").selectExpr(
        "CAST(event_id AS STRING) AS event_id",
        f"CASE WHEN event_id % 7 = 0 THEN {_TOKEN} ELSE CAST(value AS STRING) END AS value",
        f"CASE WHEN event_id % 5 = 0 THEN {_TOKEN} ELSE CAST(user_id AS STRING) END AS user_id",
        f"CASE WHEN event_id % 3 = 0 THEN {_TOKEN} ELSE props END AS props",
        "CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END AS even",
        f"{_TOKEN} AS nothing",
    )
    return read_csv(spark, write_table(texts, scratch_path(spark, "na"), "csv"))


@query("read_json_records", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def read_json_records(spark, sf_dir):
    out = read_json(spark, write_table(table(spark, sf_dir, "documents"), scratch_path(spark, "docs") + ".json", "json"))
    return out.select("doc_id", "text", "lang", "source", "n_chars")


@query(
    "read_dispatch",
    "SELECT 'csv' AS format, p_partkey, p_name, p_size, p_retailprice FROM part UNION ALL "
    "SELECT 'json', p_partkey, p_name, p_size, p_retailprice FROM part UNION ALL "
    "SELECT 'parquet', p_partkey, p_name, p_size, p_retailprice FROM part",
)
def read_dispatch(spark, sf_dir):
    parts, out = table(spark, sf_dir, "part"), None
    for fmt in ("csv", "json", "parquet"):
        uri = write_table(parts, f"{scratch_path(spark, 'part')}.{fmt.upper()}", fmt)
        frame = read_table(spark, uri).select(
            F.lit(fmt).alias("format"), "p_partkey", "p_name", F.col("p_size").cast("int").alias("p_size"), "p_retailprice"
        )
        out = frame if out is None else out.unionAll(frame)
    return out


@query("read_sniff", "SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, turn, role, text FROM conversations")
def read_sniff(spark, sf_dir):
    talk, out = table(spark, sf_dir, "conversations"), None
    for fmt in ("csv", "json"):
        frame = read_any(spark, write_table(talk, scratch_path(spark, "talk"), fmt)).select("conv_id", "turn", "role", "text")
        out = frame if out is None else out.unionAll(frame)
    return out


@query("roundtrip_csv", "SELECT event_id, user_id, event_type, value, props, value > 100 AS high FROM events")
def roundtrip_csv(spark, sf_dir):
    df = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "event_type", "value", "props", "value > 100 AS high")
    return read_table(spark, write_table(df, scratch_path(spark, "saved") + ".csv", "csv"))


SHAPES = {"lineitem": 11, "orders": 6, "events": 6, "documents": 5, "embeddings": 3, "region": 2}


@query(
    "validate_shape",
    union_all(
        [
            f"SELECT '{t}' AS table_name, count(*) AS row_count, {k} AS column_count, count(*) <= 100000 AND {k} <= 100 AS accepted FROM {t}"
            for t, k in SHAPES.items()
        ]
    ),
)
def validate_shape(spark, sf_dir):
    rows = []
    for name in SHAPES:
        df = table(spark, sf_dir, name)
        try:
            check_shape(df)
            accepted = True
        except ValueError:
            accepted = False
        rows.append((name, *table_shape(df), accepted))
    return spark.createDataFrame(rows, "table_name string, row_count bigint, column_count int, accepted boolean")


@query(
    "read_csv_quoted",
    "SELECT doc_id, text, n_chars FROM documents WHERE trim(text) <> '' UNION ALL "
    "SELECT doc_id + 1000000000, lang, n_chars FROM documents WHERE trim(text) <> ''",
)
def read_csv_quoted(spark, sf_dir):
    # Texts with line breaks and quotes in some files, plain ones in others; both are read in splits.
    docs = table(spark, sf_dir, "documents").filter("trim(text) <> ''")
    path = scratch_path(spark, "quoted")
    write_table(docs.select("doc_id", "text", "n_chars"), f"{path}/broken.csv", "csv")
    write_table(docs.selectExpr("doc_id + 1000000000 AS doc_id", "lang AS text", "n_chars"), f"{path}/plain.csv", "csv")
    return read_csv(spark, f"{path}/*.csv")


@query(
    "read_json_array",
    "SELECT doc_id, text, CAST(n_chars AS BIGINT) AS n_chars, lang AS language, source AS origin FROM documents",
)
def read_json_array(spark, sf_dir):
    # One array of nested objects in every large file, as record exports are; each is read in splits.
    docs = table(spark, sf_dir, "documents")
    item = F.to_json(F.struct("doc_id", "text", "n_chars", F.struct("lang", F.array(F.struct("source")).alias("from")).alias("about")))
    files = in_large_files(docs, F.coalesce(F.octet_length("text"), F.lit(0)) + 100)
    path = scratch_path(spark, "array")
    files.select(item.alias("item")).mapInArrow(as_array, "line string").write.option("lineSep", " ").text(path)
    read = read_json(spark, path)
    return read.select("doc_id", "text", "n_chars", F.col("about.lang").alias("language"), F.col("about.from")[0]["source"].alias("origin"))


@query(
    "read_csv_quoted_file",
    "SELECT doc_id, text, lang, CASE WHEN doc_id % 3 = 0 THEN 'a \"b\"' || chr(10) || chr(13) || chr(10) || 'c,' || source ELSE source END AS source, "
    "n_chars FROM documents WHERE trim(text) <> ''",
)
def read_csv_quoted_file(spark, sf_dir):
    # Large files with line breaks, quotes and separators in most records; each is read in splits.
    docs = table(spark, sf_dir, "documents").filter("trim(text) <> ''")
    broken = F.concat(F.lit('a "b"\n\r\nc,'), "source")
    rows = docs.select("doc_id", "text", "lang", F.when(F.col("doc_id") % 3 == 0, broken).otherwise(F.col("source")).alias("source"), "n_chars")
    files = in_large_files(rows, F.octet_length("text") + 50)
    return read_csv(spark, write_table(files, scratch_path(spark, "broken") + ".csv", "csv"))


@query(
    "read_json_dates",
    "SELECT event_id, date_trunc('second', ts) AS created_at, CASE WHEN event_id % 2 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d') END AS date, "
    "strftime(ts, '%Y-%m-%d') AS day FROM events",
)
def read_json_dates(spark, sf_dir):
    # Only a column with a telling name whose every value is a moment becomes one.
    texts = table(spark, sf_dir, "events").selectExpr(
        "event_id", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS created_at",
        "CASE WHEN event_id % 2 = 0 THEN 'soon' ELSE date_format(ts, 'yyyy-MM-dd') END AS date", "date_format(ts, 'yyyy-MM-dd') AS day",
    )
    read = read_json(spark, write_table(texts, scratch_path(spark, "dates"), "json"))
    return read.select("event_id", "created_at", "date", "day")


@query("read_json_columns", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def read_json_columns(spark, sf_dir):
    # One object of columns, each an object of cells by row label.
    cells = table(spark, sf_dir, "nation").select(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey")).alias("r"))

    def by_row(column):
        return F.map_from_entries(F.transform("r", lambda x: F.struct(x["n_nationkey"].cast("string"), x[column]))).alias(column)

    columns = [by_row(c) for c in ("n_nationkey", "n_name", "n_regionkey")]
    path = write_table(cells.select(*columns).coalesce(1), scratch_path(spark, "columns"), "json")
    return read_json(spark, path)


@query("read_json_column_files", "SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM orders")
def read_json_column_files(spark, sf_dir):
    # Many files of one object of columns each, by key range; row labels start anew in every file.
    names = ("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    orders = table(spark, sf_dir, "orders")
    cells = orders.groupBy(F.floor(F.col("o_orderkey") / 5000).alias("part")).agg(F.collect_list(F.struct(*names)).alias("r"))

    def by_row(column):
        return F.map_from_entries(F.transform("r", lambda x, i: F.struct(i.cast("string"), x[column]))).alias(column)

    path = scratch_path(spark, "columns")
    one_each = cells.select(*[by_row(c) for c in names]).write.option("maxRecordsPerFile", 1)
    one_each.option("ignoreNullFields", False).json(path)
    return read_json(spark, path)


_NAMED = """WITH u AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id + 1000000, 'https://files.example.org/data/' || page_id || '/set.v' || page_id || '.csv?sig=a/b.json' FROM pages
UNION ALL SELECT page_id + 2000000, 'https://files.example.org/index.json' FROM pages UNION ALL SELECT page_id + 3000000, 'plain.csv' FROM pages)"""


@query(
    "dataset_name",
    _NAMED
    + """, f AS (SELECT page_id, list_extract(string_split(rtrim(string_split(url, '?')[1], '/'), '/'), -1) AS file FROM u),
s AS (SELECT page_id, CASE WHEN length(file) - length(replace(file, '.', '')) >= 1 AND strpos(reverse(file), '.') BETWEEN 2 AND length(file) - 1
THEN left(file, length(file) - strpos(reverse(file), '.')) ELSE '' END AS stem FROM f)
SELECT page_id, CASE WHEN stem IN ('', 'index', 'default') THEN 'dataset_from_url' ELSE stem END AS dataset_name FROM s""",
)
def name_datasets(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    urls = (
        pages.selectExpr("page_id", "url")
        .unionAll(
            pages.selectExpr(
                "page_id + 1000000",
                "concat('https://files.example.org/data/', page_id, '/set.v', page_id, '.csv?sig=a/b.json')",
            )
        )
        .unionAll(pages.selectExpr("page_id + 2000000", "'https://files.example.org/index.json'"))
        .unionAll(pages.selectExpr("page_id + 3000000", "'plain.csv'"))
    )
    return urls.select("page_id", dataset_name(F.col("url")).alias("dataset_name"))


@query(
    "synth_table",
    "WITH n AS (SELECT count(*) AS n FROM orders) SELECT o_orderkey AS row_number, "
    "substr('ABCD', (o_orderkey % 4 + 1)::INT, 1) AS categorical_col_1, substr('ABCD', (o_orderkey % 4 + 1)::INT, 1) AS categorical_col_4, "
    "substr('ABCD', (o_orderkey % 4 + 1)::INT, 1) AS categorical_col_7, round(o_orderkey * (n * 1.5::DOUBLE / (n - 1)), 6) AS float_col_2, "
    "round(o_orderkey * (n * 1.5::DOUBLE / (n - 1)), 6) AS float_col_5, round(o_orderkey * (n * 1.5::DOUBLE / (n - 1)), 6) AS float_col_8 FROM orders, n",
)
def synth(spark, sf_dir):
    # As many rows as there are orders; their keys are the row numbers.  The noisy columns are random.
    orders = table(spark, sf_dir, "orders")
    columns = [c for c in synth_columns(F.col("o_orderkey"), orders.count()) if c is not None]
    out = orders.select(F.col("o_orderkey").alias("row_number"), *columns)
    out = out.select("row_number", *[c for c in out.columns if c.startswith(("categorical", "float"))])
    return rounded(out, "float_col_2", "float_col_5", "float_col_8")


# ---------------------------------------------------------------- registry

_DATASET = [
    "CAST(o_orderkey AS STRING) AS id",
    "o_orderdate AS \"createdAt\"",
    "CAST(o_custkey AS STRING) AS \"userId\"",
    "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey % 10 AS STRING) END AS \"collaborationId\"",
    "CAST(o_orderkey % 1000 AS INT) AS rows",
    "CAST(o_orderkey % 20 + 1 AS INT) AS columns",
    "CASE WHEN o_orderpriority = '5-LOW' THEN 'failed' WHEN o_orderstatus = 'F' THEN 'completed' "
    "WHEN o_orderstatus = 'O' THEN 'uploaded' ELSE 'processing' END AS status",
    "CASE o_orderkey % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'smart' ELSE 'deep' END AS mode",
    "CASE WHEN o_orderkey % 5 = 0 THEN concat('https://files.example.org/', CAST(o_orderkey AS STRING), '.csv') END AS \"rawUrl\"",
    "CASE WHEN o_orderkey % 5 = 1 THEN concat('data/', CAST(o_orderkey AS STRING), '/raw.csv') "
    "ELSE concat(CAST(o_orderkey AS STRING), '/raw.csv') END AS \"rawDataPath\"",
]
DATASETS = (
    "SELECT " + ", ".join(_DATASET) + ", o_orderdate + to_hours((o_orderkey % 48)::BIGINT) AS \"updatedAt\" FROM orders"
)
GRAPHS = (
    "SELECT CAST(event_id AS STRING) AS id, CAST(CAST(floor(event_id / 3) AS BIGINT) AS STRING) AS \"datasetId\", event_type AS type, "
    "CASE WHEN event_id % 4 <> 0 THEN 'value' END AS \"column\" FROM events"
)


def datasets(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        *[c.replace('"', "`") for c in _DATASET],
        "o_orderdate + make_dt_interval(0, CAST(o_orderkey % 48 AS INT), 0, 0) AS `updatedAt`",
    )


def graphs(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(event_id AS STRING) AS id",
        "CAST(CAST(floor(event_id / 3) AS BIGINT) AS STRING) AS `datasetId`",
        "event_type AS type",
        "CASE WHEN event_id % 4 <> 0 THEN 'value' END AS `column`",
    )


LOGS = {
    "cleaning": "SELECT CAST(l_orderkey AS STRING) AS dataset_id, concat('column_', CAST(l_linenumber AS STRING)) AS subject, "
    "CAST(l_quantity AS INT) AS amount FROM lineitem WHERE l_returnflag = 'A'",
    "outlier": "SELECT CAST(l_orderkey AS STRING), concat('column_', CAST(l_linenumber AS STRING)), CAST(l_quantity AS INT) FROM lineitem WHERE l_returnflag = 'N'",
    "feature": "SELECT CAST(l_orderkey AS STRING), concat('column_', CAST(l_linenumber AS STRING)), CAST(l_quantity AS INT) FROM lineitem WHERE l_returnflag = 'R'",
    "graph": "SELECT CAST(CAST(floor(event_id / 3) AS BIGINT) AS STRING), event_type, 0 FROM events",
}


@query(
    "registry_get",
    f"SELECT id, status, mode, rows FROM ({DATASETS}) WHERE id IN (SELECT \"datasetId\" FROM ({GRAPHS}))",
)
def registry_get(spark, sf_dir):
    wanted = graphs(spark, sf_dir).select("datasetId")
    return registry.get_all(datasets(spark, sf_dir), wanted).select("id", "status", "mode", "rows")


REQUESTS = {
    "everything": {},
    "one collaboration": {"collaboration": "3"},
    "its completed": {"collaboration": "3", "status": "completed"},
    "one user": {"user": "7"},
}
_FILTERS = {"collaboration": '"collaborationId"', "status": "status", "user": '"userId"'}


@query(
    "registry_list",
    union_all(
        [
            f"SELECT '{request}' AS request, id, \"userId\" AS user_id, \"collaborationId\" AS collaboration_id, status, mode "
            f"FROM ({DATASETS}) WHERE " + " AND ".join(["true", *[f"{_FILTERS[k]} = '{v}'" for k, v in given.items()]])
            for request, given in REQUESTS.items()
        ]
    ),
)
def registry_list(spark, sf_dir):
    out = None
    for request, given in REQUESTS.items():
        found = registry.listing(datasets(spark, sf_dir), **given).select(
            F.lit(request).alias("request"),
            "id",
            F.col("userId").alias("user_id"),
            F.col("collaborationId").alias("collaboration_id"),
            "status",
            "mode",
        )
        out = found if out is None else out.unionAll(found)
    return out


@query(
    "registry_logs",
    "WITH l AS ("
    + union_all([f"SELECT '{k}' AS log, * FROM ({s}) AS t(dataset_id, subject, amount)" for k, s in LOGS.items()])
    + f") SELECT log, dataset_id, subject, amount FROM l WHERE dataset_id IN (SELECT id FROM ({DATASETS}) WHERE status = 'failed')",
)
def registry_logs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_orderkey AS STRING) AS datasetId",
        "CONCAT('column_', l_linenumber) AS subject",
        "CAST(l_quantity AS INT) AS amount",
        "l_returnflag",
    )
    logs = {
        "cleaning": lines.filter("l_returnflag = 'A'").drop("l_returnflag"),
        "outlier": lines.filter("l_returnflag = 'N'").drop("l_returnflag"),
        "feature": lines.filter("l_returnflag = 'R'").drop("l_returnflag"),
        "graph": graphs(spark, sf_dir).select("datasetId", F.col("type").alias("subject"), F.lit(0).alias("amount")),
    }
    failed = registry.listing(datasets(spark, sf_dir), status="failed").select("id")
    out = None
    for name, log in logs.items():
        part = registry.get_all(log, failed, "datasetId").select(
            F.lit(name).alias("log"), F.col("datasetId").alias("dataset_id"), "subject", "amount"
        )
        out = part if out is None else out.unionAll(part)
    return out


@query(
    "collab_graphs",
    f"""SELECT d.id AS dataset_id, g.type, g."column" AS column_name, '/dataset/' || d.id || '/graph/' || g.id AS url
FROM ({DATASETS}) d JOIN ({GRAPHS}) g ON g."datasetId" = d.id WHERE d."collaborationId" IS NOT NULL""",
)
def collab_graphs(spark, sf_dir):
    out = registry.collaboration_graphs(datasets(spark, sf_dir), graphs(spark, sf_dir))
    return out.withColumnRenamed("column", "column_name")


@query(
    "collab_cleaned",
    f"""SELECT id, rows AS row_count, columns AS column_count, status, "userId" AS user_id, "collaborationId" AS collaboration_id,
'https://prep.example.org/dataset/' || id || '/cleaned' AS url FROM ({DATASETS}) WHERE "collaborationId" IS NOT NULL AND status = 'completed'""",
)
def collab_cleaned(spark, sf_dir):
    out = registry.collaboration_cleaned(datasets(spark, sf_dir), "https://prep.example.org/")
    return out.withColumnsRenamed({"rows": "row_count", "columns": "column_count"})


@query(
    "progress_info",
    f"SELECT id, status, CASE status "
    + " ".join(f"WHEN '{s}' THEN '{t}'" for s, t in registry.PROGRESS.items())
    + f" END AS progress_info FROM ({DATASETS})",
)
def progress_info(spark, sf_dir):
    return datasets(spark, sf_dir).select("id", "status", registry.progress(F.col("status")).alias("progress_info"))


@query("visible_datasets", f"SELECT id, \"userId\" AS user_id FROM ({DATASETS}) WHERE \"userId\" = '7' OR \"collaborationId\" IS NOT NULL")
def visible_datasets(spark, sf_dir):
    return registry.visible(datasets(spark, sf_dir), "7").select("id", F.col("userId").alias("user_id"))


@query("mode_usage", f"SELECT \"userId\" AS user_id, mode, count(*) AS uses FROM ({DATASETS}) GROUP BY ALL")
def mode_usage(spark, sf_dir):
    return registry.mode_usage(datasets(spark, sf_dir)).withColumnRenamed("userId", "user_id")


@query(
    "quota_admission",
    f"""SELECT id, mode, use_number, CASE mode WHEN 'smart' THEN use_number <= 3 WHEN 'deep' THEN use_number <= 1 ELSE true END AS admitted
FROM (SELECT *, row_number() OVER (PARTITION BY "userId", mode ORDER BY "createdAt", id) AS use_number FROM ({DATASETS}))""",
)
def quota_admission(spark, sf_dir):
    usage = datasets(spark, sf_dir).select("id", "userId", "mode", "createdAt")
    return registry.quota_admission(usage).select("id", "mode", "use_number", "admitted")


_RECENT = f"SELECT * FROM ({DATASETS}) ORDER BY \"createdAt\" DESC, id DESC LIMIT 100"


@query(
    "recent_status_counts",
    f"SELECT s.status, count(r.id) AS n FROM (VALUES ('uploaded'), ('processing'), ('completed'), ('failed')) AS s(status) "
    f"LEFT JOIN ({_RECENT}) r ON r.status = s.status GROUP BY s.status",
)
def recent_status_counts(spark, sf_dir):
    return registry.recent_status_counts(datasets(spark, sf_dir))


@query(
    "stuck_and_newest",
    f"""WITH r AS ({_RECENT}) SELECT (SELECT count(*) FROM r WHERE status = 'processing') AS processing,
(SELECT id FROM r WHERE status = 'processing' ORDER BY "updatedAt", id LIMIT 1) AS oldest_processing,
(SELECT count(*) FROM r WHERE status = 'completed') AS completed,
(SELECT id FROM r WHERE status = 'completed' ORDER BY "updatedAt" DESC, id DESC LIMIT 1) AS newest_completed""",
)
def stuck_and_newest(spark, sf_dir):
    return registry.stuck_and_newest(datasets(spark, sf_dir))


@query(
    "job_routing",
    f"SELECT id, mode, CASE WHEN mode = 'deep' THEN 'eda_deep' ELSE 'eda_fast' END AS queue_name, "
    f"CASE WHEN mode = 'deep' THEN 1800 ELSE 600 END AS time_limit FROM ({DATASETS})",
)
def job_routing(spark, sf_dir):
    mode = F.col("mode")
    return datasets(spark, sf_dir).select(
        "id", "mode", registry.queue(mode).alias("queue_name"), registry.time_limit(mode).alias("time_limit")
    )


_RUNS = f"SELECT id, status, rows % 7 <> 0 AS success, rows / 1000.0::DOUBLE AS elapsed_time FROM ({DATASETS})"


@query(
    "run_summary",
    f"""SELECT count(*) AS datasets, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed,
round(avg(elapsed_time), 6) AS avg_elapsed, round(count(*) FILTER (success) / 12.5::DOUBLE, 6) AS throughput,
round(count(*) FILTER (success AND status IN ('completed', 'failed')) * 1.0::DOUBLE / count(*) FILTER (success), 6) AS processed_share,
count(*) FILTER (success AND status IN ('completed', 'failed')) >= 0.9 * count(*) FILTER (success) AS mostly_done FROM ({_RUNS})""",
)
def run_summary(spark, sf_dir):
    runs = datasets(spark, sf_dir).selectExpr("status", "rows % 7 <> 0 AS success", "rows / CAST(1000 AS DOUBLE) AS elapsed_time")
    return rounded(registry.run_summary(runs, 12.5), "avg_elapsed", "throughput", "processed_share")


@query(
    "queue_stats",
    f"""SELECT CASE WHEN mode = 'deep' THEN 'eda_deep' ELSE 'eda_fast' END AS queue_name, count(*) FILTER (status = 'uploaded') AS queued,
count(*) FILTER (status = 'processing') AS started, count(*) FILTER (status = 'completed') AS finished, count(*) FILTER (status = 'failed') AS failed,
count(*) AS total, epoch(TIMESTAMP '2030-01-01 00:00:00')::BIGINT - epoch(min("createdAt") FILTER (status = 'uploaded'))::BIGINT AS oldest_job_age
FROM ({DATASETS}) GROUP BY 1""",
)
def queue_stats(spark, sf_dir):
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    return registry.queue_stats(datasets(spark, sf_dir), now)


@query(
    "registry_latest",
    f"""SELECT id, CASE WHEN rows % 2 = 0 THEN 'completed' ELSE status END AS status, CASE WHEN rows % 2 = 0 THEN rows + 1 ELSE rows END AS row_count FROM ({DATASETS})""",
)
def registry_latest(spark, sf_dir):
    first = datasets(spark, sf_dir).select("id", "updatedAt", "status", "rows")
    later = first.filter("rows % 2 = 0").selectExpr(
        "id", "updatedAt + make_dt_interval(0, 1, 0, 0) AS updatedAt", "'completed' AS status", "rows + 1 AS rows"
    )
    return registry.latest(first.unionAll(later)).select("id", "status", F.col("rows").alias("row_count"))


@query(
    "prepare_dataset_twice",
    "SELECT 'events' AS id, 'completed' AS status, (SELECT count(*) FROM events) AS row_count, 1 AS completed_versions, 1 AS log_rows, "
    "(SELECT count(*) FROM events) AS table_rows",
)
def prepare_dataset_twice(spark, sf_dir):
    # Two runs of one dataset: the latest completed version counts, with its own log rows and table.
    root = scratch_path(spark, "registry")
    row = spark.createDataFrame([("events", "u", "fast", "uploaded", f"{sf_dir}/events.parquet")], "id string, userId string, mode string, status string, rawUrl string")
    registry.append(row, "Dataset", root)
    for _ in range(2):
        result = prepare_dataset(spark, root, "events", f"{root}-store", charts=False)
    versions = registry.read(spark, "Dataset", root)
    logs = registry.current_logs(registry.read(spark, "OutlierLog", root), versions)
    last = registry.latest(versions.filter("status = 'completed'"))
    return last.select("id", "status", F.col("rows").alias("row_count")).withColumns(
        {
            "completed_versions": F.lit(last.count()).cast("int"),
            "log_rows": F.lit(logs.count()).cast("int"),
            "table_rows": F.lit(read_table(spark, last.first()["cleanedUrl"]).count()).cast("bigint"),
        }
    )


@query(
    "registry_log_lookup",
    "WITH l AS (SELECT 'column_' || l_linenumber AS \"column\", CAST(l_quantity AS BIGINT) AS q, l_orderkey FROM lineitem) "
    "SELECT 'table' AS scope, \"column\", count(*) AS lines, CAST(sum(q) AS BIGINT) AS outliers FROM l GROUP BY \"column\" UNION ALL "
    "SELECT 'dataset', \"column\", count(*), CAST(sum(q) AS BIGINT) FROM l WHERE l_orderkey = (SELECT max(l_orderkey) FROM lineitem) GROUP BY \"column\"",
)
def registry_log_lookup(spark, sf_dir):
    # Logs written in more appends than a level holds, then read as a whole and for one dataset.
    root = scratch_path(spark, "registry")
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_orderkey AS STRING) AS datasetId", "concat('column_', l_linenumber) AS column", "CAST(l_quantity AS BIGINT) AS outlierCount",
        "pmod(xxhash64(l_orderkey, l_linenumber), 18) AS part", "l_orderkey",
    )
    for part in range(18):
        registry.append(lines.filter(F.col("part") == part).drop("part"), "OutlierLog", root)
    last = str(lines.agg(F.max("l_orderkey")).first()[0])
    out = None
    for scope, logs in (("table", registry.read(spark, "OutlierLog", root)), ("dataset", registry.read(spark, "OutlierLog", root, last))):
        counted = logs.groupBy("column").agg(F.count(F.lit(1)).alias("lines"), F.sum("outlierCount").alias("outliers"))
        counted = counted.select(F.lit(scope).alias("scope"), "column", "lines", "outliers")
        out = counted if out is None else out.unionAll(counted)
    return out


@query(
    "registry_location",
    f"""SELECT id, coalesce("rawUrl", CASE WHEN "rawDataPath" LIKE 'data/%' THEN "rawDataPath" ELSE 'data/' || "rawDataPath" END) AS location FROM ({DATASETS})""",
)
def registry_location(spark, sf_dir):
    return datasets(spark, sf_dir).select("id", location(F.col("rawUrl"), F.col("rawDataPath"), "data").alias("location"))


# ---------------------------------------------------------------- advice answers


def _shaped(body):
    """Put an object into the shapes answers come in."""
    return (
        F.when(F.col("shape") == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(F.col("shape") == 1, F.concat(F.lit("```\n"), body, F.lit("```")))
        .when(F.col("shape") == 2, F.concat(F.lit("  "), body, F.lit("\n")))
        .when(F.col("shape") == 3, F.concat(F.lit("```json\n"), body))
        .when(F.col("shape") == 4, F.concat(F.lit("["), body, F.lit("]")))
        .when(F.col("shape") == 5, F.concat(body, F.lit(" trailing words")))
        .otherwise(F.lit("I cannot say."))
    )


@query(
    "parse_strategy",
    """SELECT doc_id, CASE WHEN shape <= 3 THEN CASE WHEN doc_id % 5 = 0 THEN 'mean' ELSE source END
WHEN numeric THEN 'median' ELSE 'mode' END AS action, CASE WHEN shape <= 3 THEN CASE WHEN doc_id % 4 = 0 THEN 'No reason provided' ELSE text END
WHEN numeric THEN 'Default: median for numerical columns' ELSE 'Default: mode for categorical columns' END AS reason
FROM (SELECT doc_id, text, source, doc_id % 7 AS shape, doc_id % 2 = 0 AS numeric FROM documents)""",
)
def parse_strategy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("shape", F.col("doc_id") % 7)
    body = F.to_json(
        F.struct(
            F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("action"),
            F.when(F.col("doc_id") % 4 != 0, F.col("text")).alias("reason"),
        )
    )
    asked = docs.select(
        "doc_id", _shaped(body).alias("answer"), F.when(F.col("doc_id") % 2 == 0, "double").otherwise("string").alias("dtype")
    )
    return advice.parse_strategy(asked).select("doc_id", "action", "reason")


@query(
    "parse_feature_advice",
    """WITH a AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, o_orderkey % 7 AS shape FROM orders)
SELECT o_orderkey, 'encoding' AS list, 0 AS position, o_orderpriority AS column_name, 'one-hot' AS method, NULL::VARCHAR AS name, 'few' AS reason FROM a WHERE shape <= 3
UNION ALL SELECT o_orderkey, 'encoding', 1, 'city', 'label', NULL, NULL FROM a WHERE shape <= 3
UNION ALL SELECT o_orderkey, 'drop', 0, o_orderstatus, NULL, NULL, 'Low importance' FROM a WHERE shape <= 3
UNION ALL SELECT o_orderkey, 'drop', 1, 'note', NULL, NULL, 'Low importance' FROM a WHERE shape <= 3
UNION ALL SELECT o_orderkey, 'new_features', 0, NULL, NULL, 'AgeGroup', 'buckets' FROM a WHERE shape <= 3""",
)
def parse_feature_advice(spark, sf_dir):
    body = F.format_string(
        '{"encoding": [{"column": "%s", "method": "one-hot", "reason": "few"}, {"column": "city", "method": "label"}], '
        '"scaling": [], "drop": ["%s", "note"], "new_features": [{"name": "AgeGroup", "reason": "buckets"}]}',
        F.col("o_orderpriority"),
        F.col("o_orderstatus"),
    )
    orders = table(spark, sf_dir, "orders").withColumn("shape", F.col("o_orderkey") % 7)
    steps = advice.parse_features(orders.select("o_orderkey", _shaped(body).alias("answer")), "o_orderkey")
    return steps.select("o_orderkey", "list", "position", F.col("column").alias("column_name"), "method", "name", "reason")


@query(
    "parse_report",
    r"""SELECT conv_id, turn, CASE WHEN shape <= 3 THEN text END AS reasoning, CASE WHEN shape <= 3 THEN CASE WHEN turn % 2 = 0 THEN role ELSE 'No summary provided' END END AS summary,
CASE WHEN shape <= 3 THEN CASE conv_id % 3 WHEN 0 THEN '- ' || role || E'\n- ' || text WHEN 1 THEN text ELSE 'No recommendations provided' END END AS recommendations
FROM (SELECT *, (conv_id + turn) % 7 AS shape FROM conversations)""",
)
def parse_report(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").withColumn("shape", (F.col("conv_id") + F.col("turn")) % 7)
    listed = F.to_json(
        F.struct(
            F.col("text").alias("reasoning"),
            F.when(F.col("turn") % 2 == 0, F.col("role")).alias("summary"),
            F.array("role", "text").alias("recommendations"),
        )
    )
    plain = F.to_json(
        F.struct(
            F.col("text").alias("reasoning"),
            F.when(F.col("turn") % 2 == 0, F.col("role")).alias("summary"),
            F.when(F.col("conv_id") % 3 == 1, F.col("text")).alias("recommendations"),
        )
    )
    body = F.when(F.col("conv_id") % 3 == 0, listed).otherwise(plain)
    out = advice.parse_report(talk.select("conv_id", "turn", _shaped(body).alias("answer")))
    return out.select("conv_id", "turn", "reasoning", "summary", "recommendations")


_LOG = [
    "doc_id AS seq",
    "concat('column about ', source, ' in language ', lang) AS \"column\"",
    "concat('Filled with mode (', text, ')') AS action",
    "n_chars AS null_count",
    "CASE WHEN doc_id % 3 <> 0 THEN text END AS reason",
]


@query(
    "report_log_digest",
    "SELECT seq, left(\"column\", 30) AS column_name, left(action, 80) AS action, null_count, coalesce(left(reason, 100), '') AS reason "
    f"FROM (SELECT {', '.join(_LOG)} FROM documents) ORDER BY seq LIMIT 10",
)
def report_log_digest(spark, sf_dir):
    log = table(spark, sf_dir, "documents").selectExpr(*[c.replace('"', "`") for c in _LOG])
    return advice.report_digest(log).withColumnRenamed("column", "column_name")


@query(
    "fallback_report",
    """SELECT dataset_id, 'Dataset cleaned using ' || n || ' actions. AI-assisted cleaning was attempted but report generation encountered an error: ' || left(error, 100) AS reasoning,
'Cleaned ' || n || ' columns with missing values. Data quality improved.' AS summary,
'Review cleaned data for domain-specific validation. Consider retrying for detailed AI-generated report.' AS recommendations
FROM (SELECT source AS dataset_id, count(*) AS n, max(text) AS error FROM documents GROUP BY source) WHERE NOT (lower(error) LIKE '%quota%' OR error LIKE '%429%' OR lower(error) LIKE '%rate limit%')""",
)
def fallback_report(spark, sf_dir):
    counted = (
        table(spark, sf_dir, "documents")
        .groupBy(F.col("source").alias("dataset_id"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("text").alias("error"))
    )
    reasoning, summary, recommendations = advice.fallback_report(F.col("n"), F.col("error"))
    return counted.filter(~advice.is_quota_error(F.col("error"))).select(
        "dataset_id", reasoning.alias("reasoning"), summary.alias("summary"), recommendations.alias("recommendations")
    )


# ---------------------------------------------------------------- request rates

LIMIT, WINDOW = 5, 86_400
_FRAME = "PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86399999999 MICROSECONDS PRECEDING AND CURRENT ROW"


@query("rate_sliding", f"SELECT event_id, prior, prior >= 5 AS denied FROM (SELECT event_id, count(*) OVER ({_FRAME}) - 1 AS prior FROM events)")
def rate_sliding(spark, sf_dir):
    out = rate.sliding_counts(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", WINDOW)
    return out.select("event_id", "prior", (F.col("prior") >= LIMIT).alias("denied"))


@query(
    "rate_columns",
    f"""SELECT event_id, prior, prior >= 5 AS denied, CASE WHEN prior < 5 THEN 5 - prior - 1 END AS remaining,
floor((now + 86400000000) / 1000000)::BIGINT AS reset, CASE WHEN prior >= 5 THEN greatest(1, floor((oldest + 86400000000 - now) / 1000000)::BIGINT + 1) END AS retry_after
FROM (SELECT event_id, epoch_us(ts) AS now, count(*) OVER ({_FRAME}) - 1 AS prior, epoch_us(min(ts) OVER ({_FRAME})) AS oldest FROM events)""",
)
def rate_columns(spark, sf_dir):
    out = rate.audit(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", LIMIT, WINDOW)
    return out.select("event_id", "prior", "denied", "remaining", "reset", "retry_after")


ADMISSION = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
walk AS (SELECT user_id, rn, event_id, [t] AS times, true AS admitted FROM e WHERE rn = 1
UNION ALL SELECT e.user_id, e.rn, e.event_id,
CASE WHEN len(list_filter(w.times, lambda x: x > e.t - 86400000000)) < 5 THEN list_append(list_filter(w.times, lambda x: x > e.t - 86400000000), e.t)
ELSE list_filter(w.times, lambda x: x > e.t - 86400000000) END, len(list_filter(w.times, lambda x: x > e.t - 86400000000)) < 5
FROM walk w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)
SELECT event_id, user_id, admitted FROM walk"""


@query("rate_admission", ADMISSION)
def rate_admission(spark, sf_dir):
    out = rate.admission(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", LIMIT, WINDOW)
    return out.select("event_id", "user_id", "admitted")


# ---------------------------------------------------------------- streams


def _stream(spark, sf_dir, name):
    return file_stream(spark, sf_dir, table(spark, sf_dir, name).schema, f"{name}.parquet")


def _run(spark, stream, label, output_mode="append"):
    """Run a stream over what has arrived and return what it wrote."""
    path = scratch_path(spark, label)
    write_stream(stream, path, f"{path}-checkpoint", output_mode).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query(
    "stream_apply",
    f"""WITH d AS ({GAPPY.sql}), f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, m FROM (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, max(m) AS m
FROM (SELECT coalesce(value, (SELECT median(value) FROM d)) AS value, (SELECT median(value) FROM d) AS m FROM d)))
SELECT event_id, round(CASE WHEN v < lo THEN lo WHEN v > hi THEN hi ELSE v END, 6) AS value FROM (SELECT event_id, coalesce(value, m) AS v, lo, hi FROM d, f)""",
)
def stream_apply(spark, sf_dir):
    still = GAPPY.frame(spark, sf_dir).select("event_id", "value")
    cleaning = plan_cleaning(still)
    capping = plan_outliers(cleaning.apply(still))
    moving = _stream(spark, sf_dir, "events").selectExpr(*GAPPY.columns).select("event_id", "value")
    return rounded(_run(spark, apply_to_stream(apply_to_stream(moving, cleaning), capping), "applied"), "value")


@query("stream_prepare", ORACLES["prepare_events"])
def stream_prepare(spark, sf_dir):
    plan = prepare(GAPPY.frame(spark, sf_dir), charts=False).plan
    moving = _stream(spark, sf_dir, "events").selectExpr(*GAPPY.columns)
    return rounded(_run(spark, apply_to_stream(moving, plan), "prepared"), "value")


@query(
    "stream_intake",
    f"""WITH d AS (SELECT id, mode, CASE WHEN rows % 3 = 0 THEN NULL ELSE rows END AS n FROM ({DATASETS}))
SELECT id, mode, coalesce(n, (SELECT round_even(CASE WHEN (SELECT (quantile_cont(n, 0.75) - quantile_cont(n, 0.25)) / (max(n) - min(n)) FROM d) < 0.3
THEN (SELECT median(n) FROM d) ELSE (SELECT avg(n) FROM d) END, 0)::BIGINT)) AS n FROM d""",
)
def stream_intake(spark, sf_dir):
    # Every batch is profiled and cleaned like a table of its own; the second delivery finds nothing new.
    path = scratch_path(spark, "intake")
    for delivery in ("first", "again"):
        arriving = _stream(spark, sf_dir, "orders").selectExpr(*[c.replace('"', "`") for c in _DATASET])
        slim = arriving.selectExpr("id", "mode", "CASE WHEN rows % 3 = 0 THEN NULL ELSE CAST(rows AS BIGINT) END AS n")
        intake(slim, "id", lambda batch: clean(batch)[0], path, f"{path}-{delivery}").awaitTermination()
    return spark.read.schema("id string, mode string, n bigint").parquet(f"{path}/batch=*")


@query(
    "stream_intake_datasets",
    "SELECT 'events' AS id, 'completed' AS status, count(*) AS row_count, 1 AS completed_runs, 0 AS failed_runs FROM events UNION ALL "
    "SELECT 'lost', 'failed', NULL, 0, 4 UNION ALL SELECT 'orders', 'completed', count(*), 1, 0 FROM orders UNION ALL "
    "SELECT 'part', 'completed', count(*), 1, 0 FROM part",
)
def stream_intake_datasets(spark, sf_dir):
    # One dataset of the batch cannot be read: it alone fails, twice per delivery; the second delivery repeats no other.
    root = scratch_path(spark, "registry")
    given = [(n, "fast", "uploaded", f"{sf_dir}/{f}.parquet") for n, f in (("events", "events"), ("orders", "orders"), ("part", "part"), ("lost", "no_such_table"))]
    registry.append(spark.createDataFrame(given, "id string, mode string, status string, rawUrl string"), "Dataset", root)
    arriving = f"{root}-arriving"
    registry.read(spark, "Dataset", root).write.parquet(arriving)
    schema = spark.read.parquet(arriving).schema
    for delivery in ("first", "again"):
        moving = file_stream(spark, arriving, schema, files_per_trigger=2)
        intake_datasets(moving, root, f"{root}-store", f"{root}-{delivery}", charts=False).awaitTermination()
    versions = registry.read(spark, "Dataset", root)
    runs = versions.groupBy("id").agg(
        F.count_if(F.col("status") == "completed").cast("int").alias("completed_runs"),
        F.count_if(F.col("status") == "failed").cast("int").alias("failed_runs"),
    )
    return registry.latest(versions).select("id", "status", F.col("rows").alias("row_count")).join(runs, "id")


@query(
    "stream_rate_windows",
    """WITH w AS (SELECT user_id, epoch_us(ts) AS t, i.i AS i FROM events, range(6) AS i(i)),
s AS (SELECT user_id, t - t % 10000000 - i * 10000000 AS left_edge FROM w),
c AS (SELECT user_id, left_edge, count(*) AS requests FROM s GROUP BY user_id, left_edge)
SELECT make_timestamp(left_edge) AS window_start, make_timestamp(left_edge + 60000000) AS window_end, user_id, requests FROM c
WHERE left_edge + 60000000 <= (SELECT (epoch_ms(max(ts)) - 600000) * 1000 FROM events)""",
)
def stream_rate_windows(spark, sf_dir):
    out = _run(spark, rate_windows(_stream(spark, sf_dir, "events"), "user_id", "ts"), "windows")
    return out.select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        F.col("window_end").cast("timestamp_ntz").alias("window_end"),
        "user_id",
        "requests",
    )


@query("stream_admission", ADMISSION)
def stream_admission(spark, sf_dir):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        moving = admit_stream(_stream(spark, sf_dir, "events"), "user_id", "ts", "event_id", LIMIT, WINDOW, "10 minutes")
        return _run(spark, moving, "admitted").select("event_id", "user_id", "admitted")
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
