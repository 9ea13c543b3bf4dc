"""Running totals over a globally ordered table, without a one-task window.

A window with no partition key would sort the whole table in one task. Here
the rows are first grouped by key (so every key is unique and no key is heavy),
then dealt into ranges of about equal size, as many as the table needs, and
written with the number of their range. A range that came out too large makes
the ranges finer until every one fits. Each range is a window partition of its
own; what lies in the ranges before it is a running total over one row per
range, joined back by the number of the range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vistrata.functions.columns import col
from vistrata.plans.session import materialise

# Rows ordered in one task; larger tables are cut into ranges.
RANGE_ROWS = 500_000
# A range may hold so many times the rows asked for before the ranges are made finer.
RANGE_EXCESS = 4


def _order(keys: list[str], descending: bool) -> list[Column]:
    return [col(k).desc() if descending else col(k) for k in keys]


def running_totals(
    table: DataFrame,
    keys: list[str],
    weights: list[str],
    n_rows: int,
    descending: bool = False,
    range_rows: int | None = None,
) -> DataFrame:
    """Add ``before_<w>`` per weight: its sum over all rows ordered earlier.

    ``keys`` must be unique and free of NULLs; ``n_rows`` is the (estimated) size
    of the table. Weights are integers. The running totals exclude the row
    itself. ``next_<w>`` is the weight of the following row.
    """
    range_rows = range_rows or RANGE_ROWS
    if n_rows <= range_rows:
        placed, starts = table.withColumn("_range", F.lit(0)), None
    else:
        placed, earlier, opening = _cut_into_ranges(
            table, keys, weights, n_rows, descending, range_rows
        )
        starts = earlier.join(opening, "_range")
    window = Window.partitionBy("_range").orderBy(*_order(keys, descending))
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    within = placed
    for w in weights:
        within = within.withColumns({
            f"before_{w}": F.coalesce(F.sum(col(w)).over(before), F.lit(0)).cast("long"),
            f"next_{w}": F.lead(col(w)).over(window).cast("long"),
        })
    if starts is None:
        return within.drop("_range")
    # One row per range; Spark broadcasts it if its measured size allows.
    moved = within.join(starts, "_range")
    return moved.withColumns({
        **{f"before_{w}": col(f"before_{w}") + col(f"_earlier_{w}") for w in weights},
        **{f"next_{w}": F.coalesce(col(f"next_{w}"), col(f"_opening_{w}")) for w in weights},
    }).drop("_range", *[f"_{side}_{w}" for side in ("earlier", "opening") for w in weights])


def _cut_into_ranges(table, keys, weights, n_rows, descending, range_rows):
    """The rows with ``_range``, and per range the sums before it and the next range's first weights.

    The number of a range is its place in the order. There is no bound on the number
    of ranges; the driver sees none of them.
    """
    order = _order(keys, descending)
    ranges = max(2, -(-n_rows // range_rows))
    while True:
        dealt = table.repartitionByRange(ranges, *order)
        placed = materialise(dealt.withColumn("_range", F.spark_partition_id()), "ordered")
        largest, n = placed.groupBy("_range").count().agg(F.max("count"), F.sum("count")).first()
        if (largest or 0) <= RANGE_EXCESS * range_rows:
            break
        # Keys are unique, so finer ranges end this.
        ranges = max(2 * ranges, -(-n // range_rows))

    key = F.struct(*[col(k) for k in keys])
    pick = F.max_by if descending else F.min_by
    stats = placed.groupBy("_range").agg(
        *[F.sum(col(w)).cast("long").alias(f"_sum_{w}") for w in weights],
        *[pick(col(w), key).cast("long").alias(f"_first_{w}") for w in weights])
    # One row per range of half a million rows: a small table in one window.
    in_order = Window.partitionBy(F.lit(0)).orderBy("_range")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    earlier = stats.select("_range", *[
        F.coalesce(F.sum(f"_sum_{w}").over(before), F.lit(0)).alias(f"_earlier_{w}")
        for w in weights])
    opening = stats.select("_range", *[
        F.lead(f"_first_{w}").over(in_order).alias(f"_opening_{w}") for w in weights])
    return placed, earlier, opening
