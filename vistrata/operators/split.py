"""Model input tables: complete rows with a row key, splits and folds by hash.

The key of a row is a digest of its values and of its number among equal rows, so a
split depends on the rows alone and not on files, partitions or recomputed tasks.
The prepared rows are written once: every training pass reads that table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from vistrata.functions.columns import (
    as_double, col, is_numeric, normalise_missing, numeric_columns, require, require_numeric,
)
from vistrata.operators.features import check_problem_type
from vistrata.operators.quantiles import kth_smallest
from vistrata.plans.session import materialise

SEED = 42
# Splits are stratified up to this many classes.
STRATIFIED_CLASSES = 20
# Equal rows that are written out together, and rows of a task that writes them.
COPIES_PER_TASK = 10_000
ROWS_PER_TASK = 100_000
# Class codes are sent to every task up to this many.
BROADCAST_CLASSES = 100_000
# Hashes are cut to 52 bits, 13 hex digits: exact as doubles.
_HASH_SPACE, _HASH_DIGITS = 1 << 52, 13
_KEY_DIGITS = 15


@dataclass
class Prepared:
    """Rows ``_row, _f0.._fk, label`` ready for training."""

    rows: DataFrame
    target: str
    problem_type: str
    feature_cols: list[str]
    # Class values in label order, or None for a numeric regression target.
    classes: list | None
    numeric_target: bool
    inputs: list[str] = field(default_factory=list)
    # Tables and sums that several fits share, by what they are for.
    shared: dict = field(default_factory=dict)


def input_names(features: list[str]) -> list[str]:
    return [f"_f{i}" for i in range(len(features))]


def usable_inputs(df: DataFrame, target: str, asked: list[str] | None) -> list[str]:
    """The asked-for columns that exist (all numeric ones by default), less the target."""
    pool = numeric_columns(df) if not asked else asked
    present = set(df.columns) - {target}
    return list(filter(present.__contains__, pool))


def prepare(
    df: DataFrame,
    target: str,
    problem_type: str = "regression",
    feature_cols: list[str] | None = None,
) -> Prepared:
    """Keep complete rows, turn features into doubles and classes into sorted codes."""
    check_problem_type(problem_type)
    require(df, target)
    names = usable_inputs(df, target, feature_cols)
    if not names:
        raise ValueError("no feature columns")
    require_numeric(df, *names)
    numeric_target = is_numeric(df, target)
    y = as_double(df, target) if numeric_target else col(target).cast("string")
    inputs = input_names(names)
    rows = normalise_missing(df).select(
        *[as_double(df, c).alias(i) for c, i in zip(names, inputs)], y.alias("label")
    ).na.drop()
    classes, names_of_rows = None, [*inputs, "label"]
    groups = _equal_rows(rows, names_of_rows)
    if problem_type == "classification" or not numeric_target:
        # A model holds parameters per class, so the driver may hold the class names.
        found = groups.select("label").distinct().orderBy("label").collect()
        classes = [r[0] for r in found]
        codes = df.sparkSession.createDataFrame(
            [(c, float(i)) for i, c in enumerate(classes)],
            f"label {rows.schema['label'].dataType.simpleString()}, _code double")
        # Spark does not know the size of a table from the driver and would sort all rows by
        # their class.
        if len(classes) <= BROADCAST_CLASSES:
            codes = F.broadcast(codes)
        groups = groups.join(codes, "label").select(
            *inputs, F.col("_code").alias("label"), "_copies")
    keyed = _written_out(groups, names_of_rows)
    return Prepared(
        materialise(keyed, "model-rows"), target, problem_type, names, classes, numeric_target,
        inputs,
    )


def with_row_keys(rows: DataFrame, names: list[str]) -> DataFrame:
    """The rows with ``_row``, a digest of their values and their number among equal rows."""
    return _written_out(_equal_rows(rows, names), names)


def _equal_rows(rows: DataFrame, names: list[str]) -> DataFrame:
    """The distinct rows with their number ``_copies``, combined before the shuffle."""
    groups = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies"))
    return materialise(groups, "row-groups")


def _written_out(groups: DataFrame, names: list[str]) -> DataFrame:
    """Equal rows by their number among them, with their key.

    The copies of a row are dealt over tasks in blocks. The tasks follow from the rows that
    they write: the distinct rows may be few, and Spark would make one task of them.
    """
    blocks = groups.withColumn("_block", F.explode(F.sequence(
        F.lit(0).cast("long"), F.expr(f"(_copies - 1) div {COPIES_PER_TASK}"))))
    first = F.col("_block") * COPIES_PER_TASK + 1
    n = groups.agg(F.sum("_copies")).first()[0] or 0
    dealt = blocks.repartition(max(1, -(-n // ROWS_PER_TASK)), *names, "_block")
    # The text of the values is made once for all copies; it is null where all of them are.
    values = [F.col(c).cast("string") for c in names]
    texts = dealt.withColumn(
        "_text", F.when(F.coalesce(*values).isNotNull(), F.concat_ws("|", *values)))
    each = texts.withColumn("_copy", F.explode(F.sequence(
        first, F.least(first + (COPIES_PER_TASK - 1), F.col("_copies")))))
    text = F.concat_ws("|", "_text", F.col("_copy").cast("string"))
    return each.select(*names, _digits(text, _KEY_DIGITS).alias("_row"))


def _digits(text: Column, n: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, n), 16, 10).cast("long")


def row_hash(seed: int) -> Column:
    text = F.concat(F.lit(f"{seed}:"), F.col("_row").cast("string"))
    return _digits(text, _HASH_DIGITS).cast("double")


def test_sizes(counts: dict, test_size: float) -> dict:
    """Test rows per class: ceil(n*size) in all, shared by largest remainder."""
    n = sum(counts.values())
    wanted = math.ceil(n * test_size)
    shares = {c: wanted * m / n for c, m in counts.items()}
    sizes = {c: math.floor(s) for c, s in shares.items()}
    by_rest = sorted(counts, key=lambda c: (sizes[c] - shares[c], c))
    for c in by_rest[: wanted - sum(sizes.values())]:
        sizes[c] += 1
    return sizes


def _border_request(h: Column, n: int, wanted: int):
    """Where the wanted-th smallest of n uniform hashes lies, give or take eight deviations."""
    share = wanted / n
    reach = 8 * math.sqrt(share * (1 - share) / n) + 8 / n
    return (h, wanted - 1, max(0.0, share - reach) * _HASH_SPACE,
            min(1.0, share + reach) * _HASH_SPACE)


def mark_test(data: Prepared, test_size: float = 0.2, seed: int = SEED,
              stratified_classes: int = STRATIFIED_CLASSES) -> DataFrame:
    """Add ``_test``: exactly ceil(n*size) rows.

    Up to ``stratified_classes`` classes (20, the rule of the survey) each class gives its
    share; more classes, and numeric targets, are split as a whole. The test rows are those with the smallest hashes; the border is an exact order
    statistic of the hashes, so no sort or window over the rows is needed.
    """
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    rows, h = data.rows, F.col("_hash")
    stratify = (
        data.problem_type == "classification" and len(data.classes) <= stratified_classes
    )
    if not stratify:
        n = rows.count()
        if n < 2:
            raise ValueError("a split needs at least two complete rows")
        rows = _hashed(rows, seed)
        request = _border_request(h, n, math.ceil(n * test_size))
        border = kth_smallest(rows, {"all": request})["all"]
        return rows.withColumn("_test", h <= F.lit(border)).drop("_hash")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if min(counts.values(), default=0) < 2:
        raise ValueError("the least frequent class has fewer than two rows")
    sizes = test_sizes(counts, test_size)
    wanted = {c: m for c, m in sizes.items() if m}
    rows = _hashed(rows, seed)
    borders = kth_smallest(rows, {
        str(c): _border_request(F.when(F.col("label") == c, h), counts[c], m)
        for c, m in wanted.items()
    })
    limit = F.lit(-1.0)
    for c in wanted:
        limit = F.when(F.col("label") == c, F.lit(borders[str(c)])).otherwise(limit)
    return rows.withColumn("_test", h <= limit).drop("_hash")


def _hashed(rows: DataFrame, seed: int) -> DataFrame:
    """The rows with ``_hash``, computed once for the search of the border and every later scan."""
    return materialise(rows.withColumn("_hash", row_hash(seed)), "split-hashes")


def fold_of(folds: int, seed: int = SEED) -> Column:
    """Cross-validation fold of a row, independent of the split."""
    return F.pmod(row_hash(seed + 1).cast("long"), F.lit(folds)).cast("int")
