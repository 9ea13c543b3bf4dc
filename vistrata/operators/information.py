"""Mutual information by nearest neighbours, without bins.

Between two numbers the estimate follows Kraskov, Stoegbauer and Grassberger ("Estimating
mutual information", Phys. Rev. E 2004): for each row the distance to its k-th neighbour
in the plane of both, then the rows within that distance along each axis. Between a number
and a class it follows Ross ("Mutual information between discrete and continuous data
sets", PLoS ONE 2014): the distance to the k-th neighbour of the same class, then the rows
of any class within it.

Neighbours come from the partitioned search of ``knn``, all features in one search. The
rows within a distance are the difference of two places in the order of all values, where
the ends of every interval are ordered together with the values (``ordered``), so no task
looks at more than a range of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from vistrata.functions.aggregates import fit_scalars, r4
from vistrata.functions.columns import col, require_numeric
from vistrata.operators import features
from vistrata.operators.knn import nearest_neighbours
from vistrata.operators.ordered import running_totals
from vistrata.operators.split import row_hash, with_row_keys
from vistrata.plans.session import materialise

NEIGHBOURS = 3
# Size of the noise that tells equal values apart, of the mean size of the scaled values.
NOISE = 1e-10
_EULER = 0.5772156649015329
_UNIT = float(1 << 52)


def digamma(n: Column) -> Column:
    """The digamma function of whole numbers from 1 on."""
    x = n.cast("double")
    few = F.lit(None).cast("double")
    for i in range(1, 10):
        few = F.when(n == i, F.lit(sum(1 / j for j in range(1, i)) - _EULER)).otherwise(few)
    square = 1 / (x * x)
    series = F.log(x) - 0.5 / x - square * (
        F.lit(1 / 12) - square * (F.lit(1 / 120) - square / F.lit(252.0)))
    return F.when(n < 10, few).otherwise(series)


def _scaled(rows: DataFrame, names: list[str]) -> dict[str, Column]:
    """Each column over its deviation, with noise that depends on the row and column alone."""
    spread = fit_scalars(rows, {c: F.stddev_pop(col(c)) for c in names})
    scale = {c: spread[c] or 1.0 for c in names}
    size = fit_scalars(rows, {c: F.avg(F.abs(col(c) / F.lit(scale[c]))) for c in names})
    out = {}
    for i, c in enumerate(names):
        # Uniform with deviation 1.
        noise = (row_hash(1_000 + i) / F.lit(_UNIT) - 0.5) * F.lit(math.sqrt(12.0))
        out[c] = col(c) / F.lit(scale[c]) + noise * F.lit(NOISE * max(1.0, size[c] or 0.0))
    return out


def _rows_within(points: DataFrame, axis: str) -> DataFrame:
    """``key, n``: rows of the same feature nearer than ``far`` along an axis, itself included."""
    value = F.col(axis)
    # Ends lie inside the distance by a few units of the last place.
    room = F.greatest(F.col("far") * 1e-9, (F.abs(value) + F.col("far")) * 1e-15)
    ends = F.array(
        F.struct(value.alias("v"), F.lit(1).alias("side"), F.lit(1).alias("rows")),
        F.struct((value - F.greatest(F.col("far") - room, F.lit(0.0))).alias("v"),
                 F.lit(0).alias("side"), F.lit(0).alias("rows")),
        F.struct((value + F.greatest(F.col("far") - room, F.lit(0.0))).alias("v"),
                 F.lit(2).alias("side"), F.lit(0).alias("rows")))
    table = points.select("f", "key", F.explode(ends).alias("e")).select("f", "key", "e.*")
    placed = running_totals(
        materialise(table, "interval-ends"), ["f", "v", "side", "key"], ["rows"], table.count())
    ends = placed.filter("side <> 1")
    before = F.when(F.col("side") == 2, F.col("before_rows")).otherwise(-F.col("before_rows"))
    return ends.groupBy("key").agg(F.sum(before).alias("n"))


def neighbour_mutual_information(
    df: DataFrame, target: str, problem_type: str = "regression", k: int = NEIGHBOURS,
) -> DataFrame:
    """``feature, position, mutual_info`` in nats, by nearest neighbours.

    Features are numbers; a regression's target is one, too, a class target is taken as
    it is, and rows whose class occurs once are left out. Values are scaled to deviation 1
    and get noise of 1e-10 of their size, a function of the row, so that equal values have
    an order. Rows with missing values are left out; fewer than five rows give no scores.
    Negative estimates are 0.
    """
    features.check_problem_type(problem_type)
    schema = "feature string, position int, mutual_info double"
    spark = df.sparkSession
    rows, names = features.complete_rows(df, target)
    if not names or not features._enough(rows):
        return spark.createDataFrame([], schema)
    numeric = problem_type == "regression"
    if numeric:
        require_numeric(df, target)
    # Names of our own, whatever the columns are called.
    inputs, label = [f"_x{i}" for i in range(len(names))], "_y"
    rows = rows.select(*[col(c).alias(i) for c, i in zip(names, inputs)], col(target).alias(label))
    keyed = materialise(with_row_keys(rows, [*inputs, label]), "information-rows")
    if not numeric:
        often = keyed.groupBy(F.col(label).alias("_class")).agg(F.count(F.lit(1)).alias("_n"))
        # Ids of classes in their order; one row per class.
        numbered = running_totals(
            often.withColumn("one", F.lit(1)).filter("_n > 1"), ["_class"], ["one"], often.count())
        keyed = materialise(keyed.join(numbered.select(
            "_class", "_n", F.col("before_one").alias("_code")), F.col(label) == F.col("_class"))
            .drop("_class"), "information-classes")
    n = keyed.count()
    if not n:
        return spark.createDataFrame([(c, i, 0.0) for i, c in enumerate(names)], schema)
    scaled = _scaled(keyed, [*inputs, label] if numeric else inputs)
    y = scaled[label] if numeric else F.lit(0.0)
    per_feature = F.explode(F.array(*[
        F.struct(F.lit(i).alias("f"), scaled[c].alias("x")) for i, c in enumerate(inputs)]))
    others = [] if numeric else ["_n", "_code"]
    points = keyed.select("_row", y.alias("y"), *others, per_feature.alias("p")).select(
        "_row", "y", *others, "p.*")
    points = materialise(
        points.withColumn("key", F.monotonically_increasing_id()), "information-points")
    vec = F.array("x", "y") if numeric else F.array("x")
    group = F.col("f") if numeric else F.col("f") + F.col("_code") * len(names)
    search = points.select(
        F.col("key").alias("id"), F.col("key").alias("qid"), vec.alias("vec"),
        F.lit(0.0).alias("label"), F.col("key").alias("own"), group.alias("grp"))
    near = nearest_neighbours(search, search, k, part="own", group="grp", metric="chebyshev",
                              digits=None)
    reach = near.groupBy(F.col("qid").alias("key")).agg(F.max("distance").alias("far"))
    points = materialise(points.join(reach, "key"), "information-reach")
    around = points.join(_rows_within(points, "x").withColumnRenamed("n", "nx"), "key")
    if numeric:
        around = around.join(_rows_within(points, "y").withColumnRenamed("n", "ny"), "key")
        each = -digamma(F.col("nx")) - digamma(F.col("ny"))
        constant = digamma(F.lit(n)) + digamma(F.lit(k))
    else:
        at = F.least(F.lit(k), F.col("_n") - 1)
        each = digamma(at) - digamma(F.col("_n")) - digamma(F.col("nx"))
        constant = digamma(F.lit(n))
    label = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("f") + 1)
    found = around.groupBy("f").agg((F.avg(each) + constant).alias("mi"))
    return found.select(
        label.alias("feature"), F.col("f").alias("position"),
        r4(F.greatest(F.col("mi"), F.lit(0.0))).alias("mutual_info"))
