"""Read tables by file extension, with missing-value tokens and type inference for CSV."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vistrata.functions.aggregates import fit_scalars
from vistrata.functions.columns import col

# Texts that mean a missing cell.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")
SPREADSHEETS = ("xls", "xlsx", "xlsm", "xlsb", "odf", "ods", "odt")
COLUMNAR = ("parquet", "orc", "json")
_NUMBER = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|Inf|infinity|Infinity)\s*$"
_INTEGER = r"^\s*[+-]?\d+\s*$"


def load(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """Read by extension; whatever is not a known columnar format is read as CSV."""
    base = os.path.basename(path.rstrip("/"))
    extension = base.rsplit(".", 1)[-1].lower() if "." in base else ""
    if extension in SPREADSHEETS:
        raise ValueError("convert spreadsheets to CSV or Parquet first")
    if extension in COLUMNAR:
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.options(**options).format(extension).load(path)
    return load_csv(spark, path, schema, **options)


def load_csv(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """CSV with a header row.

    Files are split between tasks; pass ``multiLine=True`` if quoted cells hold line
    breaks. Cells equal to a missing token become NULL. Types are found by one aggregate
    over the text columns (integer, float, boolean, else text) unless a schema is
    given, which spares that scan.
    """
    texts = spark.read.options(
        **({"header": "true", "escape": '"', "nullValue": ""} | options)
    ).csv(path)
    cells = texts.select(*[
        F.when(~col(c).isin(*MISSING_TOKENS), col(c)).alias(c) for c in texts.columns
    ])
    if schema is not None:
        from pyspark.sql.types import StructType

        wanted = StructType.fromDDL(schema)
        return cells.select(*[col(f.name).cast(f.dataType).alias(f.name) for f in wanted.fields])
    checks: dict[str, Column] = {}
    for name in cells.columns:
        text = col(name)
        whole = text.rlike(_INTEGER) & text.try_cast("bigint").isNotNull()
        checks[f"{name}|n"] = F.count(text)
        checks[f"{name}|whole"] = F.count_if(whole)
        checks[f"{name}|number"] = F.count_if(text.rlike(_NUMBER))
        checks[f"{name}|flag"] = F.count_if(text.isin(*TRUE_TOKENS, *FALSE_TOKENS))
    seen = fit_scalars(cells, checks)

    def typed(name: str) -> Column:
        n, text = seen[f"{name}|n"], F.trim(col(name))
        if n and seen[f"{name}|whole"] == n:
            return text.cast("bigint")
        if seen[f"{name}|number"] == n:
            return text.cast("double")
        if seen[f"{name}|flag"] == n:
            return col(name).isin(*TRUE_TOKENS)
        return col(name)

    return cells.select(*[typed(c).alias(c) for c in cells.columns])


def from_pandas(spark: SparkSession, frame) -> DataFrame:
    """A small pandas table as a DataFrame; NaN becomes NULL."""
    from vistrata.functions.columns import normalise_missing

    return normalise_missing(spark.createDataFrame(frame))
