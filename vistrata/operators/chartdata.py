"""The reduced tables behind charts. Nothing here draws."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from vistrata.functions.aggregates import fit_scalars, r4
from vistrata.functions.columns import (
    as_double, col, is_numeric, normalise_missing, require, require_numeric,
)
from vistrata.operators.lookup import attach_by_value, value_sizes
from vistrata.operators.profile import (
    IQR_REACH, MAX_BINS, bin_of, histogram, iqr_bounds, missing_by_column, value_counts,
)
from vistrata.operators.quantiles import exact_quantiles, grouped_quantiles

# Bars of a categorical chart and of an importance chart.
MAX_BARS = 20


def missing_bar(df: DataFrame) -> DataFrame:
    """Columns with missing values and their share, ascending."""
    return (
        missing_by_column(df).filter("missing_pct > 0").select("column", "missing_pct")
        .orderBy("missing_pct", "column")
    )


def distribution_bars(df: DataFrame, column: str) -> DataFrame:
    """Bin midpoints and counts, or the 20 most frequent values of a category."""
    if not is_numeric(df, column):
        return value_counts(df, column, limit=MAX_BARS)
    return histogram(df, column).select(
        "bin", ((F.col("low") + F.col("high")) / 2).alias("midpoint"), "n"
    )


def scatter_bins(df: DataFrame, x: str, y: str, bins: int = MAX_BINS) -> DataFrame:
    """Counts per cell of a bins x bins grid over the range of both columns."""
    require_numeric(df, x, y)
    rows = normalise_missing(df).select(
        as_double(df, x).alias("x"), as_double(df, y).alias("y")
    ).na.drop()
    seen = fit_scalars(rows, {f"{f.__name__}_{c}": f(c) for c in "xy" for f in (F.min, F.max)})
    if seen["min_x"] is None:
        return df.sparkSession.createDataFrame([], "x_bin int, y_bin int, n long")

    def edges(c: str) -> list[float]:
        low, high = seen[f"min_{c}"], seen[f"max_{c}"]
        if low == high:
            low, high = low - 0.5, high + 0.5
        return np.linspace(low, high, bins + 1).tolist()

    return rows.groupBy(
        bin_of(F.col("x"), edges("x")).alias("x_bin"), bin_of(F.col("y"), edges("y")).alias("y_bin")
    ).agg(F.count("*").alias("n"))


def scatter_points(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Every point with both coordinates, as a lazy projection; ``scatter_bins`` reduces."""
    names = list(dict.fromkeys([x, y, *([color] if color else [])]))
    require(df, *names)
    return normalise_missing(df).select(*[col(c) for c in names]).na.drop(subset=[x, y])


def trendline(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Least-squares line of y on x: ``n, slope, intercept, r2``, one per colour group."""
    require_numeric(df, x, y)
    groups = [col(color).alias("color")] if color else []
    rows = normalise_missing(df).select(
        *groups, as_double(df, x).alias("x"), as_double(df, y).alias("y")
    ).na.drop(subset=["x", "y"])
    return rows.groupBy(*(["color"] if color else [])).agg(
        F.count("*").alias("n"),
        r4(F.regr_slope("y", "x")).alias("slope"),
        r4(F.regr_intercept("y", "x")).alias("intercept"),
        r4(F.regr_r2("y", "x")).alias("r2"),
    )


def box_stats(df: DataFrame, column: str, group: str | None = None) -> DataFrame:
    """Quartiles, whiskers (extreme values inside the fences) and outlier count.

    One row, or one per group.
    """
    require_numeric(df, column)
    if group is None:
        q1, q2, q3 = exact_quantiles(df, [column], [0.25, 0.5, 0.75])[column]
        rows = normalise_missing(df).select(as_double(df, column).alias("value")).na.drop()
        fenced = rows.select(
            "value", *[F.lit(v).cast("double").alias(k) for k, v in zip(("q0", "q1", "q2"), (q1, q2, q3))]
        )
        return _whiskers(fenced, [])
    require(df, group)
    rows = normalise_missing(df).select(
        col(group).alias("group"), as_double(df, column).alias("value")
    ).na.drop()
    quartiles = grouped_quantiles(rows, "group", "value", [0.25, 0.5, 0.75])
    values = quartiles.withColumnsRenamed({"group": "value", "n": "n_rows"})
    size = value_sizes(rows, ["group"])["group"]
    return _whiskers(attach_by_value(rows, "group", values, size), ["group"])


def _whiskers(rows: DataFrame, groups: list[str]) -> DataFrame:
    reach = IQR_REACH * (F.col("q2") - F.col("q0"))
    low, high = F.col("q0") - reach, F.col("q2") + reach
    value = F.col("value")
    inside = (value >= low) & (value <= high)
    return rows.groupBy(*groups).agg(
        F.count("*").alias("n"),
        r4(F.min(F.when(inside, value))).alias("whisker_low"),
        r4(F.max("q0")).alias("q1"), r4(F.max("q1")).alias("median"), r4(F.max("q2")).alias("q3"),
        r4(F.max(F.when(inside, value))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def outlier_points(df: DataFrame, column: str, keep: list[str] = ()) -> DataFrame:
    """Values strictly outside the IQR fences with the columns to keep."""
    require_numeric(df, column)
    lower, upper = iqr_bounds(df, [column])[column][2:]
    x = as_double(df, column)
    outside = (x < F.lit(lower).cast("double")) | (x > F.lit(upper).cast("double"))
    return normalise_missing(df).filter(outside).select(
        *[col(c) for c in keep], x.alias("value"),
        F.when(x > F.lit(upper).cast("double"), "above").otherwise("below").alias("side"),
    )


def time_series(df: DataFrame, x: str, y: str, unit: str | None = "day") -> DataFrame:
    """Average and count of y per time unit, in order of x; ``unit=None`` keeps all points."""
    require(df, x)
    require_numeric(df, y)
    rows = normalise_missing(df).select(col(x).alias("x"), as_double(df, y).alias("y"))
    if unit is None:
        return rows.orderBy("x")
    return rows.groupBy(F.date_trunc(unit, "x").alias("x")).agg(
        r4(F.avg("y")).alias("y"), F.count("y").alias("n")
    ).orderBy("x")


def importance_bars(importances: DataFrame, limit: int = MAX_BARS) -> DataFrame:
    """The strongest ``limit`` features, ascending as a bar chart draws them."""
    strongest = importances.orderBy(F.desc("importance"), "feature").limit(limit)
    return strongest.orderBy("importance", F.desc("feature"))


def model_comparison(results: DataFrame, metric: str) -> DataFrame:
    """``model_name, value, best`` of the models that trained; a missing metric is 0."""
    scored = results.filter("error is null").select(
        "model_name", F.coalesce(col(metric), F.lit(0.0)).alias("value")
    )
    # One row per model: a small table in one window.
    return scored.withColumn("best", F.col("value") == F.max("value").over(Window.partitionBy()))
