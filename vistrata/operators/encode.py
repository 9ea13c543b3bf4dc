"""Categorical encoders. All return ``(table, summary)``.

Codes and frequencies are made on the table of distinct values and attached to
the rows (see ``lookup``); no window or sort runs over the rows themselves.
"""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame, functions as F

from vistrata.functions.columns import col, normalise_missing, require
from vistrata.operators.lookup import ValueSize, attach_by_value, value_sizes
from vistrata.operators.ordered import running_totals

ENCODING_METHODS = ("label", "onehot", "onehot_sparse", "ordinal", "frequency")


def encode_categorical(
    df: DataFrame,
    column: str,
    method: str = "label",
    ordinal_order: list | None = None,
    drop_original: bool = True,
    categories: list | None = None,
    broadcast_bytes: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Encode one column; the original is dropped unless asked otherwise.

    label: position among the sorted values, missing is -1. onehot: one 0/1 column
    per listed category, or per sorted value, all 0 for missing. onehot_sparse: the
    same flags as one sparse vector, for columns of any cardinality. ordinal: position
    in the given order (or the sorted values), missing if unknown. frequency: share
    among present values.
    """
    if method not in ENCODING_METHODS:
        raise ValueError(f"method must be one of {ENCODING_METHODS}")
    require(df, column)
    clean = normalise_missing(df)
    if method == "onehot":
        result, added = _onehot(clean, column, categories)
    elif method == "onehot_sparse":
        result, added = _sparse(clean, column, broadcast_bytes)
    elif method == "ordinal" and ordinal_order:
        result, added = _given_order(clean, column, ordinal_order)
    else:
        result, added = _by_value(clean, column, method, broadcast_bytes)
    if drop_original:
        result = result.drop(column)
    summary = clean.agg(
        F.lit(column).alias("column"),
        F.lit(method).alias("method"),
        F.array(*[F.lit(c) for c in added]).cast("array<string>").alias("new_columns"),
        F.count_distinct(col(column)).alias("unique_values"),
    )
    return result, summary


def _onehot(df: DataFrame, column: str, categories: list | None) -> tuple[DataFrame, list[str]]:
    """Flag columns; their names are the schema of the result, so the driver holds them."""
    if categories is None:
        values = df.select(col(column).alias("v")).na.drop().distinct()
        categories = [r[0] for r in values.orderBy("v").collect()]
    names = {f"{column}_{v}": v for v in categories}
    flags = {
        name: F.coalesce(col(column) == F.lit(v), F.lit(False)).cast("int")
        for name, v in names.items()
    }
    return (df.withColumns(flags) if flags else df), list(names)


def _sparse(
    df: DataFrame, column: str, broadcast_bytes: int | None
) -> tuple[DataFrame, list[str]]:
    coded, (code,) = _by_value(df, column, "label", broadcast_bytes)
    name = f"{column}_onehot"
    top = coded.agg(F.max(code)).first()[0]
    # Missing values get the code after the last one, which the encoder drops.
    last = F.lit(max(-1 if top is None else top, -1) + 1).cast("double")
    place = F.when(col(code) < 0, last).otherwise(col(code).cast("double"))
    ready = coded.withColumn("_place", place)
    sizes = df.sparkSession.range(1).select(last.alias("_place"))
    encoder = OneHotEncoder(inputCols=["_place"], outputCols=[name], dropLast=True).fit(sizes)
    return encoder.transform(ready).drop("_place", code), [name]


def _given_order(df: DataFrame, column: str, order: list) -> tuple[DataFrame, list[str]]:
    name = f"{column}_ordinal"
    # The last position wins when the order repeats a value.
    codes = {v: i for i, v in enumerate(order)}
    pairs = [x for v, i in codes.items() for x in (F.lit(v), F.lit(i))]
    return df.withColumn(name, F.try_element_at(F.create_map(*pairs), col(column))), [name]


def _by_value(
    df: DataFrame, column: str, method: str, broadcast_bytes: int | None
) -> tuple[DataFrame, list[str]]:
    size: ValueSize = value_sizes(df, [column])[column]
    frequencies = (
        df.select(col(column).alias("value")).na.drop()
        .groupBy("value").agg(F.count("*").alias("n_rows"))
    )
    if method == "frequency":
        name = f"{column}_freq"
        share = F.col("n_rows") / F.lit(float(max(size.n, 1)))
        values = frequencies.withColumn(name, share)
    else:
        name = f"{column}_encoded" if method == "label" else f"{column}_ordinal"
        one_each = frequencies.withColumn("one", F.lit(1))
        ordered = running_totals(one_each, ["value"], ["one"], size.distinct)
        values = ordered.select("value", "n_rows", F.col("before_one").alias(name))
    result = attach_by_value(df, column, values, size, broadcast_bytes)
    if method == "label":
        result = result.withColumn(name, F.coalesce(col(name), F.lit(-1).cast("long")))
    return result, [name]
