"""Profile report: tidy sections for the cluster, a nested JSON document for people."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, functions as F

from vistrata.functions.aggregates import per_column, percent, r4, sample_skewness, union_all
from vistrata.functions.columns import as_double, col, normalise_missing, numeric_columns
from vistrata.operators import profile
from vistrata.operators.quantiles import exact_quantiles

SECTIONS = ("overview", "summary", "correlation", "quality")
DESCRIBED = ("count", "mean", "std", "min", "q25", "q50", "q75", "max")


def dataset_info(df: DataFrame) -> DataFrame:
    """``item, detail, value``: size of the table and type and missing cells per column."""
    seen = profile.overview(df).select(
        F.explode(F.array(*[
            F.struct(F.lit(k).alias("item"), F.lit(None).cast("string").alias("detail"),
                     F.col(k).cast("double").alias("value"))
            for k in ("n_rows", "n_columns", "duplicate_rows", "missing_cells", "approx_size_mb")
        ])).alias("r")
    ).select("r.*")
    columns = profile.missing_by_column(df).select(
        F.explode(F.array(
            F.struct(F.concat(F.lit("missing_count:"), "column").alias("item"),
                     F.col("dtype").alias("detail"),
                     F.col("missing_count").cast("double").alias("value")),
            F.struct(F.concat(F.lit("missing_pct:"), "column").alias("item"),
                     F.col("dtype").alias("detail"), F.col("missing_pct").alias("value")),
        )).alias("r")
    ).select("r.*")
    return seen.unionByName(columns)


def _long(table: DataFrame, section: str, key, stats: list[str]) -> DataFrame:
    cells = F.array(*[
        F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("value")) for s in stats
    ])
    return table.select(F.lit(section).alias("section"), key.alias("column"),
                        F.explode(cells).alias("c")).select("section", "column", "c.stat", "c.value")


def _column_cells(df: DataFrame, sections: tuple[str, ...]) -> DataFrame:
    """All per-column statistics of the sections, from one aggregate over the table."""
    clean = normalise_missing(df)
    numeric = numeric_columns(df)
    quartiles = {}
    if "summary" in sections and numeric:
        quartiles = exact_quantiles(df, numeric, [0.25, 0.5, 0.75])
    nothing = F.lit(None).cast("double")

    def stats(name: str) -> dict[str, Column]:
        absent = F.count_if(col(name).isNull())
        share = percent(absent, F.count(F.lit(1)))
        x = as_double(df, name) if name in numeric else None
        found: dict[str, Column] = {}
        for section in ("overview", "quality"):
            if section in sections:
                found[f"{section}:missing_count"] = absent.cast("double")
                found[f"{section}:missing_pct"] = share
        if "quality" in sections:
            found["quality:skewness"] = nothing if x is None else r4(sample_skewness(x))
        if "summary" in sections:
            q = quartiles.get(name, [None] * 3)
            described = {
                "count": F.count(x).cast("double"), "mean": r4(F.avg(x)),
                "std": r4(F.stddev_samp(x)), "min": r4(F.min(x)),
                **{k: r4(F.lit(v).cast("double")) for k, v in zip(("q25", "q50", "q75"), q)},
                "max": r4(F.max(x)),
            } if x is not None else dict.fromkeys(DESCRIBED, nothing)
            found |= {f"summary:{k}": v for k, v in described.items()}
        return found

    table = per_column(clean, df.columns, stats)
    cells = [
        F.struct(F.lit(section).alias("section"), F.lit(stat).alias("stat"),
                 F.col(f"`{section}:{stat}`").alias("value"))
        for section, stat in (name.split(":") for name in stats(df.columns[0]))
    ]
    long = table.select("column", F.explode(F.array(*cells)).alias("c")).select(
        "c.section", "column", "c.stat", "c.value")
    # Text columns have no numeric statistics; a numeric column keeps its empty ones.
    is_described = F.col("column").isin(numeric) if numeric else F.lit(False)
    return long.filter(F.col("value").isNotNull() | ((F.col("section") == "summary") & is_described))


def profile_report(df: DataFrame, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """All sections as one tidy table ``section, column, stat, value``."""
    parts = []
    if set(sections) & {"overview", "summary", "quality"}:
        parts.append(_column_cells(df, sections))
    if "overview" in sections:
        parts.append(_long(profile.overview(df), "overview", F.lit(""), [
            "n_rows", "n_columns", "missing_cells", "duplicate_rows", "approx_size_mb"]))
    if "summary" in sections:
        tops = profile.top_values(df)
        parts.append(tops.select(
            F.lit("summary").alias("section"), "column",
            F.concat(F.lit("top:"), "value").alias("stat"), F.col("n").cast("double").alias("value")))
    if "correlation" in sections:
        parts.append(profile.correlation_matrix(df).select(
            F.lit("correlation").alias("section"), F.col("column_x").alias("column"),
            F.col("column_y").alias("stat"), F.col("r").alias("value")))
    if "quality" in sections:
        parts.append(_long(profile.cardinality(df), "quality", F.col("column"), ["cardinality"]))
    return union_all(parts)


def write_report(df: DataFrame, path: str, sections: tuple[str, ...] = SECTIONS) -> None:
    """Write the tidy report as JSON lines, distributed."""
    profile_report(df, sections).write.mode("overwrite").json(path)


def report_document(df: DataFrame, sections: tuple[str, ...] = SECTIONS) -> dict:
    """The report as nested dictionaries; its size depends on the columns only."""
    document: dict = {}
    for section, column, stat, value in profile_report(df, sections).collect():
        document.setdefault(section, {}).setdefault(column or "table", {})[stat] = value
    if "overview" in document:
        document["overview"]["table"]["dtypes"] = dict(df.dtypes)
    return document


def save_document(df: DataFrame, path: str, sections: tuple[str, ...] = SECTIONS) -> None:
    """Write the nested report as one JSON file of the driver; missing folders are made."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        json.dump(report_document(df, sections), out, indent=2, default=str)
