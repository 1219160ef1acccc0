"""Type predicates, column references and the NaN rule.

Columns are dispatched by three predicates that look alike but differ, so each has a name:
``is_stat_numeric`` (gets numeric statistics), ``is_number`` (gets charts and outlier bounds) and
``is_text`` (gets encoded).  On Spark the first two coincide; both exclude booleans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONS = (T.FloatType, T.DoubleType, T.DecimalType)
MOMENTS = (T.TimestampType, T.TimestampNTZType, T.DateType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)

INTEGER_RANGE = {
    "tinyint": (-(2**7), 2**7 - 1),
    "smallint": (-(2**15), 2**15 - 1),
    "int": (-(2**31), 2**31 - 1),
    "bigint": (-(2**63), 2**63 - 1),
}


def col(name: str) -> Column:
    """Reference a column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_integer(dtype: T.DataType) -> bool:
    return isinstance(dtype, INTEGERS)


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, INTEGERS + FRACTIONS)


def is_stat_numeric(dtype: T.DataType) -> bool:
    return is_number(dtype)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def kind_of(dtype: T.DataType) -> str:
    if is_number(dtype):
        return "number"
    if is_text(dtype):
        return "string"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, MOMENTS):
        return "datetime"
    return "other"


def number_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_number(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    for field in df.schema.fields:
        if field.name == name:
            return field.dataType
    raise ValueError(f"no column named {name!r}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing floats may arrive as NaN; every statistic below expects them as null."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(
        *[
            F.when(F.isnan(col(c)), None).otherwise(col(c)).alias(c) if c in floats else col(c)
            for c in df.columns
        ]
    )


def as_double(name: str, dtype: T.DataType) -> Column:
    return col(name) if isinstance(dtype, T.DoubleType) else col(name).cast("double")


def text_literal(text: str | None, dtype: str) -> Column:
    """A typed literal from its text form; keeps timestamps free of driver time-zone conversion."""
    return F.lit(text).cast(dtype)


def python_text(text: str, dtype: str) -> str:
    """How a value of ``dtype`` prints in logs and generated column names."""
    if dtype == "boolean":
        return "True" if text == "true" else "False"
    if dtype in ("double", "float"):
        return repr(float(text))
    return text
