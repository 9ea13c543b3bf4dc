"""Association between columns: correlation, ANOVA, chi-square, multicollinearity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from vistrata.functions import pvalues
from vistrata.functions.aggregates import fit_scalars, r4, safe_corr
from vistrata.functions.columns import (
    as_double, col, is_numeric, normalise_missing, numeric_columns, require, require_numeric,
)
from vistrata.functions.packed import sum_vectors
from vistrata.operators.lookup import attach_by_value, value_sizes
from vistrata.operators.ordered import running_totals
from vistrata.operators.profile import correlation_pairs
from vistrata.operators.quantiles import grouped_quantiles
from vistrata.plans.session import materialise

VIF_LIMIT = 5.0


def _rounded(value: float | None, digits: int) -> float | None:
    return None if value is None else round(value, digits)


def _numeric_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    require_numeric(df, x, y)
    return normalise_missing(df).select(
        as_double(df, x).alias("x"), as_double(df, y).alias("y")
    ).na.drop()


# -- numeric against numeric ----------------------------------------------------


def pearson_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    """``n, pearson_r, pearson_p`` over rows where both columns are present."""
    seen = fit_scalars(
        _numeric_pair(df, x, y),
        {"n": F.count(F.lit(1)), "r": safe_corr(F.col("x"), F.col("y"))},
    )
    p = pvalues.correlation_p(seen["r"], seen["n"])
    return df.sparkSession.createDataFrame(
        [(seen["n"], _rounded(seen["r"], 4), _rounded(p, 6))],
        "n long, pearson_r double, pearson_p double",
    )


def average_ranks(df: DataFrame, columns: list[str], broadcast_bytes: int | None = None) -> DataFrame:
    """Replace each numeric column by its average rank (NULLs stay NULL).

    A rank depends only on the value, so ranks are made on the table of distinct
    values with their frequencies and attached to the rows.
    """
    sizes = value_sizes(df, columns)
    ranked = df
    for name in columns:
        frequencies = (
            df.select(col(name).alias("value")).na.drop()
            .groupBy("value").agg(F.count("*").alias("n_rows"))
        )
        ordered = running_totals(frequencies, ["value"], ["n_rows"], sizes[name].distinct)
        rank = F.col("before_n_rows") + (F.col("n_rows") + 1) / F.lit(2.0)
        values = ordered.select("value", "n_rows", rank.alias("_rank"))
        ranked = (
            attach_by_value(ranked, name, values, sizes[name], broadcast_bytes)
            .withColumn(name, F.col("_rank")).drop("_rank")
        )
    return ranked


def spearman_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    """``n, spearman_r, spearman_p`` from average ranks."""
    ranks = average_ranks(_numeric_pair(df, x, y), ["x", "y"])
    seen = fit_scalars(
        ranks, {"n": F.count(F.lit(1)), "r": safe_corr(F.col("x"), F.col("y"))}
    )
    p = pvalues.correlation_p(seen["r"], seen["n"])
    return df.sparkSession.createDataFrame(
        [(seen["n"], _rounded(seen["r"], 4), _rounded(p, 6))],
        "n long, spearman_r double, spearman_p double",
    )


# -- numeric against categorical ----------------------------------------------------


def group_stats(df: DataFrame, numeric: str, category: str) -> DataFrame:
    """``category, n, mean, median, std`` per group, groups sorted."""
    require(df, category)
    require_numeric(df, numeric)
    pairs = normalise_missing(df).select(
        col(category).alias("category"), as_double(df, numeric).alias("value")
    ).na.drop()
    spread = pairs.groupBy("category").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )
    medians = grouped_quantiles(pairs, "category", "value", [0.5])
    return medians.join(spread, "category").select(
        F.col("category").cast("string").alias("category"),
        "n", r4(F.col("mean")).alias("mean"), r4(F.col("q0")).alias("median"),
        r4(F.col("std")).alias("std"),
    ).orderBy("category")


def f_between_groups(rows: DataFrame, group: str, values: list[str]) -> dict[str, tuple]:
    """One-way ANOVA of several columns: ``{column: (F, p, groups, n)}``.

    Rows must be complete. One aggregate per group, combined over the groups
    around the overall mean, so large means cost no precision.
    """
    centres = fit_scalars(rows, {v: F.avg(col(v)) for v in values})
    aggregates = [F.count("*").alias("n")]
    for i, v in enumerate(values):
        shifted = col(v) - F.lit(centres[v] if centres[v] is not None else 0.0)
        aggregates += [F.avg(shifted).alias(f"m{i}"), F.var_pop(shifted).alias(f"v{i}")]
    groups = rows.groupBy(col(group)).agg(*aggregates)
    parts = {"k": F.count(F.lit(1)), "n": F.sum("n")}
    for i in range(len(values)):
        parts[f"between{i}"] = F.sum(F.col("n") * F.col(f"m{i}") * F.col(f"m{i}"))
        parts[f"within{i}"] = F.sum(F.col("n") * F.col(f"v{i}"))
    total = fit_scalars(groups, parts)
    k, n = total["k"], total["n"] or 0
    result = {}
    for i, v in enumerate(values):
        if k < 2 or n <= k:
            result[v] = (None, None, k, n)
            continue
        between = total[f"between{i}"] / (k - 1)
        within = total[f"within{i}"] / (n - k)
        if within > 0:
            f = between / within
        else:
            f = float("inf") if between > 0 else None
        result[v] = (f, pvalues.f_upper(f, k - 1, n - k), k, n)
    return result


def anova(df: DataFrame, numeric: str, category: str) -> DataFrame:
    """``groups, n, anova_f, anova_p`` (NULL under two groups)."""
    require(df, category)
    require_numeric(df, numeric)
    rows = normalise_missing(df).select(
        col(category).alias("g"), as_double(df, numeric).alias("v")
    ).na.drop()
    f, p, k, n = f_between_groups(rows, "g", ["v"])["v"]
    return df.sparkSession.createDataFrame(
        [(k, n, _rounded(f, 4), _rounded(p, 6))],
        "groups long, n long, anova_f double, anova_p double",
    )


# -- categorical against categorical ---------------------------------------------------


def _cells(df: DataFrame, x: str, y: str) -> DataFrame:
    require(df, x, y)
    return (
        normalise_missing(df).select(col(x).alias("x"), col(y).alias("y")).na.drop()
        .groupBy("x", "y").agg(F.count("*").alias("n"))
    )


def dense_cells(cells: DataFrame, y_values: list | DataFrame) -> DataFrame:
    """All cells of ``x, y, n`` counts over the given values of ``y``, zeros included.

    Values are compared as text. With a list each ``x`` holds one map of its listed
    cells, so the list bounds what a group gathers. The first column of a DataFrame
    is joined instead, whatever its number of values; missing ones are left out.
    """
    if isinstance(y_values, DataFrame):
        return _joined_cells(_as_text(cells), y_values)
    wanted = [str(v) for v in dict.fromkeys(y_values)]
    texts = _as_text(cells)
    own = F.when(F.col("y").isin(wanted), F.struct("y", "n"))
    listed = F.transform(F.array(*[F.lit(v) for v in wanted]), lambda v: F.struct(
        v.alias("y"), F.coalesce(F.try_element_at(F.col("seen"), v), F.lit(0)).alias("n")))
    return (
        texts.groupBy("x").agg(F.map_from_entries(F.collect_list(own)).alias("seen"))
        .select("x", F.explode(listed).alias("c")).select("x", "c.y", "c.n")
    )


def _joined_cells(texts: DataFrame, y_values: DataFrame) -> DataFrame:
    values = normalise_missing(y_values).select(
        col(y_values.columns[0]).cast("string").alias("y")).na.drop().distinct()
    every = texts.select("x").distinct().crossJoin(values)
    return every.join(texts, ["x", "y"], "left").select(
        "x", "y", F.coalesce("n", F.lit(0)).alias("n"))


def _as_text(cells: DataFrame) -> DataFrame:
    return cells.select(
        F.col("x").cast("string").alias("x"), F.col("y").cast("string").alias("y"), "n"
    )


def crosstab(
    df: DataFrame, x: str, y: str, y_values: list | DataFrame | None = None
) -> DataFrame:
    """``x, y, n``: contingency counts in long form.

    Without ``y_values`` these are the cells that occur, whatever their number.
    With a list or a DataFrame of values there is one cell per ``x`` and given value,
    zeros included: as many cells as distinct ``x`` times values, which is what is asked for.
    """
    cells = _cells(df, x, y)
    return _as_text(cells) if y_values is None else dense_cells(cells, y_values)


def chi_square(df: DataFrame, x: str, y: str) -> DataFrame:
    """``n, dof, chi2, chi2_p``; Yates' correction for one degree of freedom.

    Cells that do not occur need not be listed: each adds its expected count, and
    all expected counts sum to n.
    """
    cells = materialise(_cells(df, x, y), "cells")
    by_x = cells.groupBy("x").agg(F.sum("n").alias("nx"))
    by_y = cells.groupBy("y").agg(F.sum("n").alias("ny"))
    size = fit_scalars(by_x, {"k": F.count(F.lit(1)), "n": F.sum("nx")})
    rows, n = size["k"], size["n"] or 0
    columns = by_y.count()
    dof = (rows - 1) * (columns - 1) if n else 0
    if n == 0:
        statistic = None
    elif dof == 0:
        statistic = 0.0
    elif dof == 1:
        statistic = _yates(cells.collect())
    else:
        expected = F.col("nx") * F.col("ny") / F.lit(float(n))
        gap = F.col("n") - expected
        parts = fit_scalars(
            cells.join(by_x, "x").join(by_y, "y"),
            {"seen": F.sum(gap * gap / expected), "expected": F.sum(expected)},
        )
        statistic = parts["seen"] + max(0.0, n - parts["expected"])
    p = pvalues.chi2_upper(statistic, dof) if n else None
    return df.sparkSession.createDataFrame(
        [(n, dof, _rounded(statistic, 4), _rounded(p, 6))],
        "n long, dof long, chi2 double, chi2_p double",
    )


def _yates(cells: list) -> float:
    """Statistic of a 2x2 table with observed counts moved up to 0.5 towards expectation."""
    counts = {(r["x"], r["y"]): r["n"] for r in cells}
    xs, ys = sorted({x for x, _ in counts}), sorted({y for _, y in counts})
    table = np.array([[counts.get((x, y), 0) for y in ys] for x in xs], dtype=float)
    expected = np.outer(table.sum(1), table.sum(0)) / table.sum()
    gap = np.abs(table - expected)
    return float((((gap - np.minimum(0.5, gap)) ** 2) / expected).sum())


# -- dispatch ------------------------------------------------------------------------


def bivariate_kind(df: DataFrame, x: str, y: str) -> str:
    numeric = (is_numeric(df, x), is_numeric(df, y))
    if all(numeric):
        return "numeric_numeric"
    return "numeric_categorical" if any(numeric) else "categorical_categorical"


def bivariate(df: DataFrame, x: str, y: str) -> dict[str, DataFrame | str]:
    """Statistics that suit the two column kinds, each as its own DataFrame."""
    kind = bivariate_kind(df, x, y)
    if kind == "numeric_numeric":
        return {"type": kind, "pearson": pearson_pair(df, x, y),
                "spearman": spearman_pair(df, x, y)}
    if kind == "numeric_categorical":
        numeric, category = (x, y) if is_numeric(df, x) else (y, x)
        return {"type": kind, "anova": anova(df, numeric, category),
                "groups": group_stats(df, numeric, category)}
    return {"type": kind, "chi2": chi_square(df, x, y), "crosstab": crosstab(df, x, y)}


def bivariate_summary(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Scalar statistics of column pairs in long form: ``col_x, col_y, type, stat, value``."""
    rows = []
    for x, y in pairs:
        found = bivariate(df, x, y)
        kind = found.pop("type")
        for name in ("pearson", "spearman", "anova", "chi2"):
            if name in found:
                for stat, value in found[name].first().asDict().items():
                    value = None if value is None else float(value)
                    rows.append((x, y, kind, stat, value))
    return df.sparkSession.createDataFrame(
        rows, "col_x string, col_y string, type string, stat string, value double"
    ).distinct()


# -- many columns -----------------------------------------------------------------------


def _complete_numeric(df: DataFrame) -> tuple[DataFrame, list[str]]:
    names = numeric_columns(df)
    clean = normalise_missing(df).select(*[as_double(df, c).alias(c) for c in names])
    for c in names:
        clean = clean.filter(col(c).isNotNull())
    return clean, names


def vif_approx(df: DataFrame) -> DataFrame:
    """``column, vif``: 1/(1 - r²) with the strongest other column, complete rows only."""
    rows, names = _complete_numeric(df)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "column string, vif double")
    pairs = correlation_pairs(rows, names)
    long = pairs.select(F.explode(F.array("i", "j")).alias("i"), F.abs("r").alias("r"))
    strongest = long.groupBy("i").agg(F.coalesce(F.max("r"), F.lit(0.0)).alias("r"))
    rest = 1 - F.col("r") * F.col("r")
    vif = F.when(rest > 0, r4(1 / F.nullif(rest, F.lit(0.0)))).otherwise(F.lit(float("inf")))
    label = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("i") + 1)
    return strongest.select(label.alias("column"), vif.alias("vif"))


def vif_flags(df: DataFrame, limit: float = VIF_LIMIT) -> DataFrame:
    """VIF table, strongest first, with the multicollinearity flag."""
    table = vif_approx(df).withColumn("multicollinear", F.col("vif") > limit)
    return table.orderBy(F.desc("vif"), "column")


def eigen_scree(df: DataFrame) -> DataFrame:
    """``pc, eigenvalue, explained_pct, cumulative_pct`` of the correlation matrix.

    The k x k matrix is aggregated on the cluster; only its decomposition runs on
    the driver. Constant columns have no correlation and are left out.
    """
    rows, names = _complete_numeric(df)
    schema = "pc int, eigenvalue double, explained_pct double"
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], schema + ", cumulative_pct double")
    matrix = np.full((len(names), len(names)), np.nan)
    np.fill_diagonal(matrix, 1.0)
    for i, j, r in correlation_pairs(rows, names).collect():
        if r is not None:
            matrix[i, j] = matrix[j, i] = r
    useful = [i for i in range(len(names)) if np.isfinite(np.delete(matrix[i], i)).any()]
    values = np.linalg.eigvalsh(matrix[np.ix_(useful, useful)])[::-1] if useful else []
    total = float(sum(values)) or 1.0
    table = df.sparkSession.createDataFrame(
        [(i + 1, round(float(v), 4), round(float(v) / total * 100, 2))
         for i, v in enumerate(values)], schema,
    )
    # One row per column of the input: a small table, ordered in one task.
    running = Window.orderBy("pc").rowsBetween(Window.unboundedPreceding, 0)
    return table.withColumn("cumulative_pct", F.round(F.sum("explained_pct").over(running), 2))


# Further directions of a block beyond the wanted ones, and the most passes over the rows.
EIGEN_SPARE, EIGEN_PASSES, EIGEN_CHANGE = 10, 40, 1e-10


def leading_eigenvalues(df: DataFrame, count: int = 10) -> DataFrame:
    """``pc, eigenvalue, explained_pct`` of the largest ``count`` of the correlation matrix.

    For tables too wide for ``eigen_scree``: no matrix of columns by columns is built. Each
    pass multiplies the matrix by a block of vectors, as the rows times the rows' products
    with the block, summed over tasks; the vectors of all passes span a Krylov space, whose
    eigenvalues close in on the wanted ones. The driver holds columns times ``count`` numbers
    for each pass. Complete rows only; constant columns are left out; no rows give none.
    """
    rows, names = _complete_numeric(df)
    schema = "pc int, eigenvalue double, explained_pct double"
    spark = df.sparkSession
    exprs = {}
    for c in names:
        exprs |= {("m", c): F.avg(col(c)), ("s", c): F.stddev_pop(col(c))}
    seen = fit_scalars(rows, exprs | {"n": F.count(F.lit(1))}) if names else {"n": 0}
    useful = [c for c in names if seen["n"] and seen["s", c]]
    if len(useful) < 2:
        return spark.createDataFrame([], schema)
    mean, spread = (np.array([seen[kind, c] for c in useful]) for kind in ("m", "s"))
    # Names of our own, whatever the columns are called.
    inputs = [f"_x{i}" for i in range(len(useful))]
    table = materialise(rows.select(*[col(c).alias(i) for c, i in zip(useful, inputs)]), "eigen-rows")
    width = min(len(useful), count + EIGEN_SPARE)
    draw = np.random.default_rng(0).normal(size=(len(useful), width))
    block, blocks, images, before = np.linalg.qr(draw)[0], [], [], None
    while True:
        image = _times_correlation(table, inputs, mean, spread, block) / seen["n"]
        blocks.append(block)
        images.append(image)
        basis = np.hstack(blocks)
        small = basis.T @ np.hstack(images)
        found = np.linalg.eigvalsh((small + small.T) / 2)[::-1][:count]
        settled = before is not None and len(before) == len(found) and (
            np.abs(found - before).max() <= EIGEN_CHANGE * found[0])
        if settled or len(blocks) == EIGEN_PASSES:
            break
        before, rest = found, image
        for _ in range(2):
            rest = rest - basis @ (basis.T @ rest)
        left, sizes, _ = np.linalg.svd(rest, full_matrices=False)
        block = left[:, sizes > 1e-10 * max(found[0], 1.0)]
        room = len(useful) - basis.shape[1]
        if not room or not block.shape[1]:
            break
        block = block[:, :room]
    values = [(i + 1, round(float(max(v, 0.0)), 4), round(float(v) / len(useful) * 100, 2))
              for i, v in enumerate(found)]
    return spark.createDataFrame(values, schema)


def _times_correlation(table: DataFrame, inputs: list[str], mean, spread, block) -> np.ndarray:
    """The sums of products of the standardised rows with themselves, times ``block``."""
    shared = table.sparkSession.sparkContext.broadcast((mean, spread, block))

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mean, spread, block = shared.value
        total = np.zeros(block.shape)
        for batch in batches:
            z = (batch[inputs].to_numpy(float) - mean) / spread
            total += z.T @ (z @ block)
        yield pd.DataFrame({"part": [0], "sums": [total.tobytes()]})

    sent = table.mapInPandas(multiply, "part long, sums binary")
    return np.frombuffer(sum_vectors(sent, ["part"]).first()["sums"]).reshape(block.shape)
