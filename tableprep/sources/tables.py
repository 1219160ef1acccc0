"""Reading and writing user tables: CSV, JSON and Parquet behind any URI Spark can open."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep.functions.types import col
from tableprep.operators.profile import EXPRESSIONS_PER_JOB
from tableprep.session import scoped_path
from tableprep.sources.ranges import first_character, json_lines, quoted_csv

# The texts that mean "missing" in a CSV field.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
TRUE_TEXTS = ["True", "TRUE", "true"]
FALSE_TEXTS = ["False", "FALSE", "false"]
FORMATS = ("csv", "json", "parquet")
DEFAULT_NAME = "dataset_from_url"
MAX_ROWS = 100_000
CELL_BYTES = 4 << 20  # of files of columns, whose cells one task puts together; in memory they are many times larger
MAX_COLUMNS = 100

_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$|^\s*[+-]?(?i:inf|infinity)\s*$"


def _is_type(text: Column, kind: str) -> Column:
    if kind == "bigint":
        return text.rlike(_INTEGER) & text.try_cast("bigint").isNotNull()
    if kind == "double":
        return text.rlike(_NUMBER)
    return text.isin(TRUE_TEXTS + FALSE_TEXTS)


def _as_type(text: Column, kind: str) -> Column:
    if kind == "boolean":
        return F.when(text.isin(TRUE_TEXTS), True).when(text.isin(FALSE_TEXTS), False)
    return F.trim(text).try_cast(kind) if kind != "string" else text


def na_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~col(c).isin(NA_TOKENS), col(c)).alias(c) for c in df.columns])


def infer_types(df: DataFrame, promote_int_nulls: bool = False) -> dict[str, str]:
    """Type of each text column from all its values: integer, float, boolean, else text.

    A column fits a type when no value fails it; an all-missing column is float.  With
    ``promote_int_nulls`` integers with gaps become float, as they do where integers cannot be null.
    """
    found: dict[str, str] = {}
    kinds = ("bigint", "double", "boolean")
    step = EXPRESSIONS_PER_JOB // (len(kinds) + 1)
    for start in range(0, len(df.columns), step):
        names = df.columns[start : start + step]
        row = df.agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.count_if(col(c).isNotNull() & ~_is_type(col(c), k)).alias(f"{k}{i}") for i, c in enumerate(names) for k in kinds],
            *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(names)],
        ).first()
        for i, c in enumerate(names):
            fits = [k for k in kinds if row[f"{k}{i}"] == 0]
            found[c] = "double" if row[f"n{i}"] == 0 else (fits[0] if fits else "string")
            if promote_int_nulls and found[c] == "bigint" and row[f"n{i}"] < row["rows"]:
                found[c] = "double"
    return found


def with_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.select(*[_as_type(col(c), types[c]).alias(c) for c in df.columns])


def files_with_open_quotes(spark: SparkSession, uri: str) -> list[str]:
    """Files in which some line leaves a quote open.  Only these cannot be read line by line."""
    line = spark.read.text(uri)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = line.filter(quotes % 2 == 1).select(F.col("_metadata.file_path").alias("path")).distinct()
    return [r["path"] for r in odd.collect()]


def has_quoted_line_breaks(spark: SparkSession, uri: str) -> bool:
    """Whether some line of some file leaves a quote open."""
    return bool(files_with_open_quotes(spark, uri))


def read_csv(
    spark: SparkSession,
    uri: str,
    types: dict[str, str] | None = None,
    multi_line: bool | None = None,
    promote_int_nulls: bool = False,
) -> DataFrame:
    """CSV with a header.  Missing-value texts become null before types are inferred.

    Inference reads the files once; pass ``types`` (column to type) to skip that, and ``multi_line``
    to skip looking for line breaks inside quotes.  All files are read in splits: those without such
    breaks line by line, the others with the state of their quotes carried from split to split.
    """
    options = {"quote": '"', "escape": '"'}
    reader = spark.read.option("header", True).options(**options)
    if multi_line is not None:
        raw = reader.option("multiLine", multi_line).csv(uri)
    else:
        broken = files_with_open_quotes(spark, uri)
        names = {_plain_path(f) for f in broken}
        plain = [f for f in spark.read.text(uri).inputFiles() if _plain_path(f) not in names] if broken else [uri]
        parts = [reader.csv(plain)] if plain else []
        parts += [quoted_csv(spark, broken, options)] if broken else []
        raw = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    raw = na_to_null(raw)
    return with_types(raw, types or infer_types(raw, promote_int_nulls))


def _plain_path(uri: str) -> str:
    return re.sub(r"^file:/+", "/", uri)


# Names of JSON columns whose values are read as moments.
DATE_ENDINGS = ("_at", "_time")
DATE_STARTS = ("timestamp",)
DATE_NAMES = ("modified", "date")


def _is_date_name(name: str) -> bool:
    low = name.lower()
    return low.endswith(DATE_ENDINGS) or low.startswith(DATE_STARTS) or low in DATE_NAMES


def with_json_dates(df: DataFrame) -> DataFrame:
    """Text columns with a telling name become timestamps where every value is one."""
    names = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and _is_date_name(f.name)]
    if not names:
        return df
    moment = {c: col(c).try_cast("timestamp_ntz") for c in names}
    row = df.agg(
        *[F.count_if(col(c).isNotNull() & moment[c].isNull()).alias(f"bad{i}") for i, c in enumerate(names)],
        *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(names)],
    ).first()
    dates = {c for i, c in enumerate(names) if row[f"bad{i}"] == 0 and row[f"n{i}"] > 0}
    return df.select(*[moment[c].alias(c) if c in dates else col(c) for c in df.columns])


def _from_columns(spark: SparkSession, uri: str) -> DataFrame:
    """Objects of columns, each an object of cells by row label or a list of cells.

    An object is one value to parse and so one task's work; its cells are spread over all after that.
    Every file has rows of its own, whatever their labels, and may lack columns that others have; a file
    has either objects or lists of cells.
    """
    text = spark.read.text(uri, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("value"))
    size = spark.read.format("binaryFile").load(uri).agg(F.sum("length")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(size / CELL_BYTES))
    lists = F.from_json("value", "map<string,array<string>>")
    named = F.from_json("value", "map<string,map<string,string>>")
    as_cells = F.transform_values(
        lists, lambda _, v: F.map_from_entries(F.transform(v, lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value"))))
    )
    shape = F.regexp_extract("value", r'^\{\s*"(?:[^"\\]|\\.)*"\s*:\s*(.)', 1)
    # cells carry a number in place of their file's name, which is longer than they are
    numbered = text.withColumn("number", F.monotonically_increasing_id())
    columns = numbered.select("number", F.explode(F.when(shape == "[", as_cells).otherwise(named)).alias("column", "cells"))
    keys = text.select("file", F.posexplode(F.json_object_keys("value")).alias("at", "column"))
    places = keys.groupBy("column").agg(F.min(F.struct("file", "at")).alias("place"))
    order = [r["column"] for r in places.orderBy("place").select("column").collect()]
    cells = columns.select("number", "column", F.explode("cells").alias("row", "cell")).repartition(parts, "number", "row")
    wide = cells.groupBy("number", "row").pivot("column", order).agg(F.first("cell"))
    wide = na_to_null(wide.toDF("__number", "__row", *order).select(*[col(c) for c in order]))
    return with_types(wide, infer_types(wide))


def read_json(spark: SparkSession, uri: str) -> DataFrame:
    """JSON records (an array of objects, or one object per line) or one object of columns per file.

    Columns named like dates (``date``, ``..._at``) become timestamps where all values are.  Arrays are cut
    into lines in splits, written once to scratch storage and read from there; an object of columns is
    parsed by one task per file.
    """
    if first_of(spark, uri) == "[":
        path = scoped_path(spark, "lines")
        json_lines(spark, uri).write.text(path)
        return with_json_dates(spark.read.json(path))
    df = spark.read.json(uri)
    if df.columns == ["_corrupt_record"]:
        df = spark.read.option("multiLine", True).json(uri)
    kinds = {f.dataType.typeName() for f in df.schema.fields}
    if df.columns and kinds <= {"struct", "array"}:
        return with_json_dates(_from_columns(spark, uri))
    return with_json_dates(df)


def is_text_source(df: DataFrame) -> bool:
    """Whether every pass over the table would parse text again."""
    return any(format_of(f) in ("csv", "json") for f in df.inputFiles()[:1])


def read_parquet(spark: SparkSession, uri: str) -> DataFrame:
    return spark.read.parquet(uri)


def first_of(spark: SparkSession, uri: str) -> str:
    """The first character of the first file that has any."""
    return next((c for c in (first_character(spark, f) for f in sorted(spark.read.text(uri).inputFiles())) if c), "")


def format_of(uri: str) -> str | None:
    """Format by lower-cased suffix, query string and fragment aside."""
    suffix = re.sub(r"[?#].*$", "", uri).rstrip("/").rsplit("/", 1)[-1].rpartition(".")[2].lower()
    return suffix if suffix in FORMATS else None


def read_table(spark: SparkSession, uri: str, fmt: str | None = None) -> DataFrame:
    """Read by suffix; anything else is refused (``read_any`` looks into the data instead)."""
    fmt = fmt or format_of(uri)
    if fmt not in FORMATS:
        raise ValueError(f"Unsupported file format: {uri}")
    return {"csv": read_csv, "json": read_json, "parquet": read_parquet}[fmt](spark, uri)


def read_any(spark: SparkSession, uri: str) -> DataFrame:
    """Read by suffix, else by the first character of the data: JSON if ``{`` or ``[``, otherwise CSV."""
    fmt = format_of(uri)
    if fmt is None:
        fmt = "json" if first_of(spark, uri) in ("{", "[") else "csv"
    return read_table(spark, uri, fmt)


def write_table(df: DataFrame, uri: str, fmt: str = "parquet") -> str:
    """Write with header and without index.  Booleans print as True/False in CSV."""
    if fmt == "csv":
        flags = {f.name for f in df.schema.fields if f.dataType.typeName() == "boolean"}
        shown = df.select(
            *[
                F.when(col(c), "True").when(~col(c), "False").alias(c) if c in flags else col(c)
                for c in df.columns
            ]
        )
        shown.write.option("header", True).option("quote", '"').option("escape", '"').csv(uri)
    elif fmt == "json":
        df.write.option("ignoreNullFields", False).json(uri)
    else:
        df.write.parquet(uri)
    return uri


def table_shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def validate_shape(df: DataFrame, max_rows: int | None = MAX_ROWS, max_columns: int | None = MAX_COLUMNS) -> None:
    """Refuse tables above the given size; None lifts a limit."""
    limits = {"rows": max_rows, "columns": max_columns}
    sizes = dict(zip(limits, table_shape(df)))
    if any(limits[k] is not None and sizes[k] > limits[k] for k in limits):
        allowed = " and ".join(f"{n:,} {k}" for k, n in limits.items() if n is not None)
        raise ValueError(f"Dataset too large. Maximum {allowed} allowed.")


def first_readable(spark: SparkSession, *uris: str | None) -> DataFrame:
    """The first location that opens."""
    errors = []
    for uri in uris:
        if uri:
            try:
                return read_any(spark, uri)
            except Exception as error:  # noqa: BLE001 - the next location may work
                errors.append(f"{uri}: {type(error).__name__}")
    raise FileNotFoundError(f"no location could be read ({'; '.join(errors) or 'none given'})")


def dataset_name(url: Column) -> Column:
    """File stem of a url or path without its query string; without a suffix, a default name."""
    file = F.regexp_extract(F.regexp_replace(url, r"\?.*$", ""), r"([^/]*)/*$", 1)
    stem = F.regexp_extract(file, r"^(.+)\.[^.]+$", 1)
    return F.when(stem.isin("", "index", "default"), DEFAULT_NAME).otherwise(stem)


def location(raw_url: Column, raw_path: Column, prefix: str) -> Column:
    """Where raw data lies: the url if any, else the key below ``prefix``, which is added once."""
    root = prefix.rstrip("/") + "/"
    key = F.when(raw_path.startswith(root), raw_path).otherwise(F.concat(F.lit(root), raw_path))
    return F.coalesce(raw_url, key)
