"""Table profile: shape, missing values, duplicates, descriptive statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from vistrata.functions.aggregates import (
    fit_scalars, per_column, percent, r4, safe_corr, sample_skewness, union_all,
)
from vistrata.functions.columns import (
    as_double, categorical_columns, col, is_numeric, normalise_missing, numeric_columns, require,
    require_numeric,
)
from vistrata.operators.quantiles import exact_quantiles

# Fixed values of the histogram rule: between 5 and 30 bins, one per ten values.
MIN_BINS, MAX_BINS, VALUES_PER_BIN = 5, 30, 10
IQR_REACH = 1.5
# Characters up to which a text is its own key when values are counted.
SHORT_TEXT = 64
# Winning keys up to this number are held by the driver; more stay a table.
FEW_KEYS = 10_000
# Row hashes that may be broadcast when repeated rows are confirmed.
REPEATED_HASHES = 100_000
# Pair aggregates per job, and the number of columns from which partial cross
# products are cheaper than one aggregate per pair.
PAIRS_IN_AGGREGATE = 60
WIDE_FROM = 6


def _empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


# -- shape, types, missing values, duplicates -------------------------------


def missing_by_column(df: DataFrame) -> DataFrame:
    """``column, position, dtype, missing_count, missing_pct`` from one scan."""
    clean = normalise_missing(df)
    types = dict(df.dtypes)

    def stats(name: str) -> dict[str, Column]:
        absent = F.count_if(col(name).isNull())
        return {
            "missing_count": absent,
            "missing_pct": percent(absent, F.count(F.lit(1))),
        }

    counted = per_column(clean, df.columns, stats)
    names = F.array(*[F.lit(t) for t in types.values()])
    return counted.withColumn("dtype", F.element_at(names, F.col("position") + 1))


def missing_totals(df: DataFrame) -> DataFrame:
    """One row: missing cells, their share of all cells and the >5 % alert flag."""
    clean = normalise_missing(df)
    absent = sum((F.count_if(col(c).isNull()) for c in df.columns), F.lit(0))
    cells = F.count(F.lit(1)) * len(df.columns)
    totals = clean.agg(
        absent.cast("long").alias("missing_cells"), percent(absent, cells).alias("missing_pct")
    )
    return totals.withColumn("alert", F.col("missing_pct") > 5.0)


def missing_matrix(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """A lazy boolean flag per cell, after the optional row keys."""
    clean = normalise_missing(df)
    flags = [col(c).isNull().alias(c) for c in df.columns if c not in keys]
    return clean.select(*[col(k) for k in keys], *flags)


def missing_patterns(df: DataFrame) -> DataFrame:
    """How many rows share each combination of missing columns."""
    flags = missing_matrix(df)
    return flags.groupBy(*[col(c) for c in flags.columns]).agg(F.count("*").alias("row_count"))


def duplicate_count(df: DataFrame, repeated_hashes: int = REPEATED_HASHES) -> int:
    """Rows equal to another row on all columns, the first of each group not counted.

    Only an 8-byte hash per row is shuffled. Rows whose hash occurs once have no
    duplicate; the others are compared in full, so hash collisions never count.
    """
    clean = normalise_missing(df)
    # Adding 0 gives -0.0 and 0.0 the same hash.
    parts = [
        col(f.name) + 0 if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else col(f.name)
        for f in df.schema.fields
    ]
    tagged = clean.withColumn("_hash", F.xxhash64(*parts))
    repeated = (
        tagged.groupBy("_hash").agg(F.count("*").alias("n")).filter("n > 1").select("_hash")
        .limit(repeated_hashes + 1).collect()
    )
    if not repeated:
        return 0
    suspects = clean
    if len(repeated) <= repeated_hashes:
        hashes = df.sparkSession.createDataFrame([tuple(r) for r in repeated], "_hash long")
        suspects = tagged.join(F.broadcast(hashes), "_hash", "left_semi").drop("_hash")
    groups = suspects.groupBy(*[col(c) for c in df.columns]).agg(F.count("*").alias("n"))
    return groups.agg(F.sum(F.col("n") - 1)).first()[0] or 0


def duplicate_rows(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(duplicate_count(df),)], "duplicate_rows long")


def _size_expression(df: DataFrame) -> Column:
    """Bytes of the plain values: fixed widths plus the bytes of texts."""
    widths = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}
    total = F.lit(0)
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.sum(F.octet_length(col(name))), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            total = total + F.coalesce(F.sum(F.octet_length(F.to_json(col(name)))), F.lit(0))
        else:
            total = total + F.count(F.lit(1)) * widths.get(kind, 8)
    return total


def approx_size(df: DataFrame) -> DataFrame:
    """``approx_size_mb``: size of the values as plain bytes, in units of 1,048,576."""
    return df.agg(r4(_size_expression(df) / 1_048_576.0).alias("approx_size_mb"))


def overview(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells, duplicate rows, approximate size."""
    clean = normalise_missing(df)
    absent = sum((F.count_if(col(c).isNull()) for c in df.columns), F.lit(0))
    return clean.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        absent.cast("long").alias("missing_cells"),
        F.lit(duplicate_count(df)).cast("long").alias("duplicate_rows"),
        r4(_size_expression(df) / 1_048_576.0).alias("approx_size_mb"),
    )


# -- descriptive statistics ---------------------------------------------------


def describe_numeric(df: DataFrame) -> DataFrame:
    """count, mean, std, min, quartiles and max of every numeric column."""
    names = numeric_columns(df)
    if not names:
        return _empty(
            df,
            "column string, position int, count long, mean double, std double, min double,"
            " q25 double, q50 double, q75 double, max double",
        )
    clean = normalise_missing(df)
    quartiles = exact_quantiles(df, names, [0.25, 0.5, 0.75])

    def stats(name: str) -> dict[str, Column]:
        x = as_double(df, name)
        q = [r4(F.lit(v).cast("double")) for v in quartiles[name]]
        return {
            "count": F.count(x), "mean": r4(F.avg(x)), "std": r4(F.stddev_samp(x)),
            "min": r4(F.min(x)),
            "q25": q[0], "q50": q[1], "q75": q[2],
            "max": r4(F.max(x)),
        }

    return per_column(clean, names, stats)


def compact_key(value: Column) -> Column:
    """A text of at most about 130 characters that stands for the value.

    Short texts are kept. A long one is cut to its beginning, which keeps the order,
    followed by its SHA-256, which keeps different texts apart; so counting long
    texts shuffles short keys.
    """
    text = value.cast("string")
    long_key = F.concat(F.substring(text, 1, SHORT_TEXT), F.lit("\x00"), F.sha2(text, 256))
    return F.when(F.char_length(text) > SHORT_TEXT, long_key).otherwise(text)


def _keyed(df: DataFrame, names: list[str]) -> DataFrame:
    """``column, key`` for every present value of the columns."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), compact_key(col(c)).alias("key")) for c in names
    ])
    return df.select(F.explode(cells).alias("r")).select("r.*").filter("key is not null")


def top_keys(df: DataFrame, names: list[str], k: int) -> DataFrame:
    """``column, key, n``: the compact keys that can be among the ``k`` most frequent values.

    Beginnings order texts as the texts do, but for equal ones; so all keys that tie
    with the last place by count and beginning are candidates.
    """
    counts = _keyed(df, names).groupBy("column", "key").agg(F.count("*").alias("n"))
    head = F.substring("key", 1, SHORT_TEXT)
    order = Window.partitionBy("column").orderBy(F.desc("n"), head.asc())
    return counts.withColumn("rank", F.rank().over(order)).filter(F.col("rank") <= k).drop("rank")


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 5) -> DataFrame:
    """``column, value, n, rank``: the ``k`` most frequent values per categorical column.

    Ties go to the smaller value. Candidates are found by their compact keys; whole
    texts are fetched for these only.
    """
    names = columns if columns is not None else categorical_columns(df)
    if not names:
        return _empty(df, "column string, value string, n long, rank int")
    clean = normalise_missing(df)
    best = top_keys(clean, names, k)
    found = best.limit(FEW_KEYS + 1).collect()
    few = len(found) <= FEW_KEYS
    if few:
        best = df.sparkSession.createDataFrame(
            [tuple(r) for r in found], "column string, key string, n long")
    is_long = F.contains(F.col("key"), F.lit("\x00"))
    texts = [c for c in names if isinstance(df.schema[c].dataType, T.StringType)]
    if few:
        texts = [c for c in texts if any(r["column"] == c and "\x00" in r["key"] for r in found)]
    value = F.col("key")
    if texts:
        cells = F.array(*[
            F.struct(F.lit(c).alias("column"), compact_key(col(c)).alias("key"),
                     col(c).alias("text")) for c in texts])
        wanted = best.filter(is_long).select("column", "key")
        whole = (
            clean.select(F.explode(cells).alias("r")).select("r.*").filter(is_long)
            .join(F.broadcast(wanted) if few else wanted, ["column", "key"])
            .groupBy("column", "key").agg(F.min("text").alias("text"))
        )
        best = best.join(whole, ["column", "key"], "left")
        value = F.coalesce("text", "key")
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return (
        best.select("column", value.alias("value"), "n")
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    )


def value_counts(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """All values with their counts, most frequent first (or the first ``limit``)."""
    require(df, column)
    if limit is not None:
        return top_values(df, [column], limit).select("value", "n").orderBy(
            F.desc("n"), F.asc("value"))
    return _counts(df, column).orderBy(F.desc("n"), F.asc("value"))


def _counts(df: DataFrame, column: str) -> DataFrame:
    return (
        normalise_missing(df).select(col(column).alias("value")).filter("value is not null")
        .groupBy("value").agg(F.count("*").alias("n"))
        .select(F.col("value").cast("string").alias("value"), "n")
    )


def categorical_stats(df: DataFrame, column: str) -> DataFrame:
    """``unique_values, top`` of a categorical column."""
    return _counts(df, column).agg(
        F.count("*").alias("unique_values"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
    )


def skewness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Bias-corrected skewness of columns with more than two values."""
    names = columns if columns is not None else numeric_columns(df)
    if not names:
        return _empty(df, "column string, position int, skewness double")
    clean = normalise_missing(df)
    found = per_column(
        clean, names, lambda c: {"skewness": r4(sample_skewness(as_double(df, c)))}
    )
    return found.filter("skewness is not null")


def skewed_columns(df: DataFrame, threshold: float = 1.0) -> DataFrame:
    return skewness(df).filter(F.abs("skewness") > threshold)


def cardinality(df: DataFrame, approximate: bool = False) -> DataFrame:
    """``column, cardinality``: distinct present values of the non-numeric columns."""
    names = [f.name for f in df.schema.fields
             if not isinstance(f.dataType, (T.NumericType, T.ArrayType, T.MapType, T.StructType))]
    clean = normalise_missing(df)
    if not names:
        return _empty(df, "column string, cardinality long")
    if approximate:
        return per_column(
            clean, names, lambda c: {"cardinality": F.approx_count_distinct(col(c))}
        ).drop("position")
    # All columns together: one shuffle of (column, key).
    keys = _keyed(clean, names).distinct().groupBy("column").agg(F.count("*").alias("seen"))
    every = df.sparkSession.createDataFrame([(c,) for c in names], "column string")
    # One row per column on either side.
    return every.join(F.broadcast(keys), "column", "left").select(
        "column", F.coalesce("seen", F.lit(0)).alias("cardinality"))


def quality_summary(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Per column: kind, rows, missing count and share, skewness or cardinality."""
    clean = normalise_missing(df)
    numeric = set(numeric_columns(df))

    def stats(name: str) -> dict[str, Column]:
        absent = F.count_if(col(name).isNull())
        skew = F.lit(None).cast("double")
        if name in numeric:
            skew = r4(sample_skewness(as_double(df, name)))
        return {
            "missing_count": absent,
            "missing_pct": percent(absent, F.count(F.lit(1))),
            "skewness": skew,
            "n_rows": F.count(F.lit(1)),
        }

    kinds = F.array(*[F.lit("numeric" if c in numeric else "non_numeric") for c in df.columns])
    found = per_column(clean, df.columns, stats).withColumn(
        "kind", F.element_at(kinds, F.col("position") + 1))
    # At most one row per column on either side.
    return found.join(F.broadcast(cardinality(df, approximate)), "column", "left")


# -- correlation ----------------------------------------------------------------


def _pair_table(df: DataFrame, names: list[str]) -> DataFrame:
    """``i, j, r`` for all i < j from one aggregate per batch of pairs."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    parts = []
    for start in range(0, len(pairs), PAIRS_IN_AGGREGATE):
        chunk = pairs[start : start + PAIRS_IN_AGGREGATE]
        wide = df.agg(*[
            safe_corr(col(names[i]), col(names[j])).alias(f"p{i}_{j}") for i, j in chunk
        ])
        cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"p{i}_{j}").alias("r"))
                 for i, j in chunk]
        parts.append(wide.select(F.explode(F.array(*cells)).alias("c")).select("c.*"))
    return union_all(parts)


def _gram_table(df: DataFrame, names: list[str]) -> DataFrame:
    """As ``_pair_table`` for many columns: masked cross products per Arrow batch.

    Each task reduces its batches to one k-by-k set of sums around the column
    means, so k*k rows per task are shuffled, whatever the size of the table.
    """
    k = len(names)
    centres = fit_scalars(df, {c: F.avg(col(c)) for c in names})
    middle = np.array([centres[c] or 0.0 for c in names])

    def partial_sums(batches):
        import pandas as pd

        total = np.zeros((6, k, k))
        for batch in batches:
            values = batch.to_numpy(dtype=float) - middle
            seen = ~np.isnan(values)
            x, m = np.where(seen, values, 0.0), seen.astype(float)
            square = x * x
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, square.T @ m, m.T @ square, x.T @ x])
        i, j = np.triu_indices(k, 1)
        sums = {name: total[t][i, j] for t, name in enumerate(("n", "x", "y", "xx", "yy", "xy"))}
        yield pd.DataFrame({"i": i, "j": j, **sums})

    sums = df.select(*[col(c) for c in names]).mapInPandas(
        partial_sums, "i int, j int, n double, x double, y double, xx double, yy double, xy double"
    )
    total = sums.groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")]
    )
    n = F.nullif(F.col("n"), F.lit(0.0))

    def scatter(squares: str, total_of: str) -> Column:
        left = F.col(squares) - F.col(total_of) * F.col(total_of) / n
        # What rounding leaves of a constant column is no variance.
        return F.when(left > F.col(squares) * 1e-12, left).otherwise(0.0)

    spread = F.sqrt(scatter("xx", "x") * scatter("yy", "y"))
    r = (F.col("xy") - F.col("x") * F.col("y") / n) / F.nullif(spread, F.lit(0.0))
    return total.select("i", "j", F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r).alias("r"))


def correlation_pairs(df: DataFrame, names: list[str], wide_from: int = WIDE_FROM) -> DataFrame:
    """Pairwise-complete Pearson ``i, j, r`` for i < j over numeric columns."""
    clean = normalise_missing(df).select(*[as_double(df, c).alias(c) for c in names])
    return (_gram_table if len(names) >= wide_from else _pair_table)(clean, names)


def correlation_matrix(df: DataFrame, wide_from: int = WIDE_FROM) -> DataFrame:
    """``column_x, column_y, r`` for every ordered pair of numeric columns.

    A constant column has no correlation, not even with itself (NULL).
    """
    names = numeric_columns(df)
    if not names:
        return _empty(df, "column_x string, column_y string, r double")
    clean = normalise_missing(df)

    def label(place: Column) -> Column:
        return F.element_at(F.array(*[F.lit(c) for c in names]), place + 1)

    diagonal = per_column(
        clean, names, lambda c: {"r": F.when(F.stddev_pop(as_double(df, c)) > 0, 1.0)}
    ).select(F.col("column").alias("column_x"), F.col("column").alias("column_y"), "r")
    if len(names) == 1:
        return diagonal
    half = correlation_pairs(df, names, wide_from).select("i", "j", r4(F.col("r")).alias("r"))
    sides = F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")),
                    F.struct(F.col("j").alias("a"), F.col("i").alias("b")))
    both = half.select(F.explode(sides).alias("c"), "r").select(
        label(F.col("c.a")).alias("column_x"), label(F.col("c.b")).alias("column_y"), "r"
    )
    return diagonal.unionByName(both)


# -- distribution and outliers ------------------------------------------------------


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Equal-width bins ``bin, low, high, n`` between minimum and maximum, last one closed."""
    require_numeric(df, column)
    x = as_double(df, column)
    clean = normalise_missing(df).select(x.alias("x")).filter("x is not null")
    seen = fit_scalars(clean, {"n": F.count("x"), "low": F.min("x"), "high": F.max("x")})
    bins = min(MAX_BINS, max(MIN_BINS, seen["n"] // VALUES_PER_BIN + 1))
    low, high = (seen["low"], seen["high"]) if seen["n"] else (0.0, 1.0)
    if not (np.isfinite(low) and np.isfinite(high)):
        raise ValueError(f"column {column!r} holds infinite values")
    if low == high:
        low, high = low - 0.5, high + 0.5
    edges = np.linspace(low, high, bins + 1).tolist()
    counted = clean.groupBy(bin_of(F.col("x"), edges).alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame(
        [(i, edges[i], edges[i + 1]) for i in range(bins)], "bin int, low double, high double"
    )
    # At most 30 rows on either side.
    return every.join(F.broadcast(counted), "bin", "left").select(
        "bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n")
    )


def bin_of(x: Column, edges: list[float]) -> Column:
    """0-based bin between consecutive edges; the last bin includes its upper edge."""
    bins = len(edges) - 1
    guess = F.floor((x - edges[0]) * (bins / (edges[-1] - edges[0]))).cast("int")
    guess = F.least(guess, F.lit(bins - 1))
    points = F.array(*[F.lit(float(e)) for e in edges])
    # The product may fall on the wrong side of an edge by one rounding step.
    step = (
        F.when(x < F.element_at(points, guess + 1), -1)
        .when((guess < bins - 1) & (x >= F.element_at(points, guess + 2)), 1)
        .otherwise(0)
    )
    return (guess + step).cast("int")


def distribution_stats(df: DataFrame, column: str) -> DataFrame:
    """``mean, median, std, min, max`` of a numeric column."""
    require_numeric(df, column)
    median = exact_quantiles(df, [column], [0.5])[column][0]
    x = as_double(df, column)
    return normalise_missing(df).agg(
        r4(F.avg(x)).alias("mean"),
        r4(F.lit(median).cast("double")).alias("median"),
        r4(F.stddev_samp(x)).alias("std"),
        r4(F.min(x)).alias("min"),
        r4(F.max(x)).alias("max"),
    )


def column_distribution(df: DataFrame, column: str) -> dict[str, DataFrame]:
    """Statistics and bins of a numeric column, or statistics and counts of another."""
    if is_numeric(df, column):
        return {"stats": distribution_stats(df, column), "bins": histogram(df, column)}
    return {"stats": categorical_stats(df, column), "value_counts": value_counts(df, column)}


def iqr_bounds(df: DataFrame, columns: list[str]) -> dict[str, tuple[float | None, ...]]:
    """``q1, q3, lower, upper`` per column."""
    found = exact_quantiles(df, columns, [0.25, 0.75])
    bounds = {}
    for name, (q1, q3) in found.items():
        if q1 is None:
            bounds[name] = (None,) * 4
        else:
            reach = IQR_REACH * (q3 - q1)
            bounds[name] = (q1, q3, q1 - reach, q3 + reach)
    return bounds


def outliers_iqr(df: DataFrame, columns: list[str] | str) -> DataFrame:
    """IQR bounds and the number of values strictly outside, per column, one scan."""
    names = [columns] if isinstance(columns, str) else columns
    bounds = iqr_bounds(df, names)
    clean = normalise_missing(df)

    def stats(name: str) -> dict[str, Column]:
        x = as_double(df, name)
        q1, q3, lower, upper = (F.lit(v).cast("double") for v in bounds[name])
        outside = F.count_if((x < lower) | (x > upper))
        return {
            "q1": r4(q1), "q3": r4(q3), "iqr": r4(q3 - q1),
            "lower": r4(lower), "upper": r4(upper),
            "outlier_count": outside, "outlier_pct": percent(outside, F.count(x)),
        }

    return per_column(clean, names, stats)


def grid_page(
    df: DataFrame,
    predicate: Column | str | None = None,
    order_by: list[Column | str] = (),
    tie_break: list[str] = (),
    page: int = 0,
    size: int = 50,
) -> DataFrame:
    """One page of the filtered and sorted table (a preview grid)."""
    rows = df if predicate is None else df.filter(predicate)
    rows = rows.orderBy(*order_by, *[col(c) for c in tie_break])
    return rows.offset(page * size).limit(size)
