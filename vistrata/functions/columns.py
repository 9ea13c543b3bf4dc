"""Which columns count as numeric or categorical, and what counts as missing.

The predicates differ on purpose: a boolean is categorical for summaries and
never part of the numeric columns, yet it is accepted wherever a single column
is asked to be numeric (there it is 0/1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def col(name: str) -> Column:
    """Column by exact name; generated names may hold ``^``, ``*`` or dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    kinds = (T.StringType, T.BooleanType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def non_numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)]


def is_numeric(df: DataFrame, name: str) -> bool:
    require(df, name)
    return isinstance(df.schema[name].dataType, (T.NumericType, T.BooleanType))


def require(df: DataFrame, *names: str) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"no such column: {', '.join(absent)}")


def require_numeric(df: DataFrame, *names: str) -> None:
    for name in names:
        if not is_numeric(df, name):
            raise ValueError(f"column {name!r} is not numeric")


def normalise_missing(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in floating columns, so that one missing marker is left."""
    floats = [f for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floats:
        return df
    return df.withColumns(
        {f.name: F.nanvl(col(f.name), F.lit(None).cast(f.dataType)) for f in floats}
    )


def as_double(df: DataFrame, name: str) -> Column:
    """The column as a double, booleans as 0/1."""
    column = col(name)
    if isinstance(df.schema[name].dataType, T.BooleanType):
        column = column.cast("int")
    return column.cast("double")
