"""Aggregate expressions with the sample conventions the operators need."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Aggregate expressions per job; wider tables are cut into several jobs so that
# generated code stays within the JIT's method size.
EXPRESSIONS_PER_JOB = 120


def r4(column: Column) -> Column:
    return F.round(column, 4)


def percent(part: Column, whole: Column) -> Column:
    """100*part/whole rounded to two decimals, 0 for an empty whole."""
    share = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)) * 100
    return F.coalesce(F.round(share, 2), F.lit(0.0))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both sides are present; NULL for a constant."""
    x_seen, y_seen = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.stddev_pop(x_seen) * F.stddev_pop(y_seen)
    r = F.covar_pop(x_seen, y_seen) / F.nullif(spread, F.lit(0.0))
    return F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r)


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness; NULL under three values, 0 for a constant column."""
    n = F.count(x).cast("double")
    bias = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n >= 3, F.coalesce(F.skewness(x) * bias, F.lit(0.0)))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def per_column(
    df: DataFrame, names: list[str], stats: Callable[[str], dict[str, Column]]
) -> DataFrame:
    """One row per column from one shared aggregate.

    ``stats(name)`` gives the aggregates of a column; they must have the same
    types for every column. Result: ``column, position`` and one field each.
    """
    width = max(1, len(stats(names[0])))
    step = max(1, EXPRESSIONS_PER_JOB // width)
    parts = []
    for start in range(0, len(names), step):
        chunk = list(enumerate(names[start : start + step], start))
        wide = df.agg(
            *[e.alias(f"{i}_{stat}") for i, name in chunk for stat, e in stats(name).items()]
        )
        rows = [
            F.struct(
                F.lit(name).alias("column"),
                F.lit(i).alias("position"),
                *[F.col(f"{i}_{stat}").alias(stat) for stat in stats(name)],
            )
            for i, name in chunk
        ]
        parts.append(wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*"))
    return union_all(parts)


def fit_scalars(df: DataFrame, exprs: dict[str, Column]) -> dict[str, object]:
    """Evaluate named aggregates and bring the one-row results to the driver."""
    names, found = list(exprs), {}
    for start in range(0, len(names), EXPRESSIONS_PER_JOB):
        chunk = names[start : start + EXPRESSIONS_PER_JOB]
        row = df.agg(*[exprs[n].alias(f"v{i}") for i, n in enumerate(chunk)]).first()
        found.update({n: row[i] for i, n in enumerate(chunk)})
    return found
