"""Missing-value imputation and outlier treatment.

Every operator returns ``(table, summary)``. Fitted values come from one
aggregate over all columns and enter the new plan as literals, so the
transformation itself is a projection.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from vistrata.functions.aggregates import fit_scalars, per_column, r4, union_all
from vistrata.functions.columns import (
    as_double, col, is_numeric, normalise_missing, require, require_numeric,
)
from vistrata.operators.profile import iqr_bounds, top_values
from vistrata.operators.quantiles import exact_quantiles

IMPUTE_STRATEGIES = ("mean", "median", "mode", "constant", "drop")
OUTLIER_METHODS = ("iqr", "zscore")
OUTLIER_ACTIONS = ("cap", "remove", "flag")

_SUMMARY = "column string, strategy string, missing_before long, missing_after long"


def _missing_counts(df: DataFrame, names: list[str]) -> dict[str, int]:
    return fit_scalars(df, {c: F.count_if(col(c).isNull()) for c in names})


def modes(df: DataFrame, names: list[str]) -> dict[str, Any]:
    """Most frequent value per column, ties to the smallest value.

    Each column is counted by a distributed aggregate that reads that column
    only; no buffer holds all values of a column.
    """
    texts = [c for c in names if isinstance(df.schema[c].dataType, T.StringType)]
    found = {}
    if texts:
        found = {r["column"]: r["value"] for r in top_values(df, texts, 1).collect()}
    names = [c for c in names if c not in texts]
    if not names:
        return found
    tops = []
    for i, name in enumerate(names):
        counts = df.select(col(name).alias("v")).na.drop().groupBy("v").agg(
            F.count("*").alias("n")
        )
        best = counts.orderBy(F.desc("n"), F.asc("v")).limit(1)
        fields = [F.col("v").alias(f"v{j}") if j == i else F.lit(None).alias(f"v{j}")
                  for j in range(len(names))]
        tops.append(best.select(F.lit(i).alias("i"), *fields))
    return found | {names[r["i"]]: r[f"v{r['i']}"] for r in union_all(tops).collect()}


def _as_column_type(df: DataFrame, name: str, value: Any) -> Column:
    """A literal of the column's type; an integer column widens for a fraction."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.IntegralType) and isinstance(value, float) and value != int(value):
        return F.lit(value)
    return F.lit(value).cast(kind)


def impute_missing(
    df: DataFrame,
    columns: list[str] | None = None,
    strategy: str = "mean",
    fill_value: Any = 0,
) -> tuple[DataFrame, DataFrame]:
    """Fill or drop missing values.

    ``columns=None`` means every column with a missing value. The summary has one
    row per column that had any; for ``drop`` it has one row ``rows_dropped``.
    Text columns are left alone by mean and median but stay in the summary.
    """
    if strategy not in IMPUTE_STRATEGIES:
        raise ValueError(f"strategy must be one of {IMPUTE_STRATEGIES}")
    require(df, *(columns or []))
    spark, clean = df.sparkSession, normalise_missing(df)
    missing = _missing_counts(clean, columns if columns is not None else df.columns)
    targets = [c for c, n in missing.items() if n]

    if strategy == "drop":
        dropped = clean.na.drop(subset=targets) if targets else clean
        gone = reduce(lambda a, b: a | b, [col(c).isNull() for c in targets], F.lit(False))
        summary = clean.agg(F.count_if(gone).alias("rows_dropped"))
        return dropped, summary

    numeric = [c for c in targets if is_numeric(df, c)]
    fills: dict[str, Column] = {}
    if strategy == "mean" and numeric:
        means = fit_scalars(clean, {c: F.avg(as_double(df, c)) for c in numeric})
        fills = {c: F.lit(v) for c, v in means.items() if v is not None}
    elif strategy == "median" and numeric:
        medians = exact_quantiles(df, numeric, [0.5])
        fills = {c: F.lit(v[0]) for c, v in medians.items() if v[0] is not None}
    elif strategy == "mode":
        fills = {c: _as_column_type(df, c, v) for c, v in modes(clean, targets).items()}
    elif strategy == "constant":
        fills = {c: _as_column_type(df, c, fill_value) for c in targets}

    def filled(name: str) -> Column:
        if strategy in ("mean", "median"):
            return F.coalesce(as_double(df, name), fills[name])
        return F.coalesce(col(name), fills[name])

    result = clean.withColumns({c: filled(c) for c in fills}) if fills else clean
    rows = [(c, strategy, missing[c], 0 if c in fills else missing[c]) for c in targets]
    return result, spark.createDataFrame(rows, _SUMMARY)


def missing_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Recount missing values on both sides of a cleaning step."""
    names = [c for c in before.columns if c in after.columns]
    sides = []
    for side, table in (("missing_before", before), ("missing_after", after)):
        counts = per_column(
            normalise_missing(table), names, lambda c: {side: F.count_if(col(c).isNull())}
        )
        sides.append(counts.select("column", side))
    # One row per column on either side.
    return sides[0].join(F.broadcast(sides[1]), "column").filter("missing_before > 0")


def outlier_bounds(
    df: DataFrame, column: str, method: str = "iqr", z_threshold: float = 3.0
) -> tuple[float | None, float | None]:
    if method not in OUTLIER_METHODS:
        raise ValueError(f"method must be one of {OUTLIER_METHODS}")
    require_numeric(df, column)
    if method == "iqr":
        return iqr_bounds(df, [column])[column][2:]
    x = as_double(df, column)
    seen = fit_scalars(normalise_missing(df), {"mean": F.avg(x), "std": F.stddev_samp(x)})
    if seen["std"] is None:
        return None, None
    reach = z_threshold * seen["std"]
    return seen["mean"] - reach, seen["mean"] + reach


def treat_outliers(
    df: DataFrame,
    column: str,
    method: str = "iqr",
    action: str = "cap",
    z_threshold: float = 3.0,
) -> tuple[DataFrame, DataFrame]:
    """Cap, remove or flag values strictly outside the bounds.

    Missing values are never outliers: they stay, are kept on removal and are
    flagged 0.
    """
    if action not in OUTLIER_ACTIONS:
        raise ValueError(f"action must be one of {OUTLIER_ACTIONS}")
    lower, upper = outlier_bounds(df, column, method, z_threshold)
    clean = normalise_missing(df)
    x = as_double(df, column)
    low, high = F.lit(lower).cast("double"), F.lit(upper).cast("double")
    outside = F.coalesce((x < low) | (x > high), F.lit(False))

    if action == "cap":
        result = clean.withColumn(column, F.when(x < low, low).when(x > high, high).otherwise(x))
        kept = F.count(F.lit(1))
    elif action == "remove":
        result, kept = clean.filter(~outside), F.count_if(~outside)
    else:
        result = clean.withColumn(f"{column}_outlier", outside.cast("int"))
        kept = F.count(F.lit(1))
    summary = clean.agg(
        F.lit(column).alias("column"), F.lit(method).alias("method"),
        F.lit(action).alias("action"),
        r4(low).alias("lower"), r4(high).alias("upper"),
        F.count_if(outside).alias("outliers_found"), kept.alias("rows_after"),
    )
    return result, summary
