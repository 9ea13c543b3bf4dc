"""Model evaluation as aggregates over label, prediction and score columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F

from vistrata.functions.aggregates import fit_scalars, r4
from vistrata.functions.columns import as_double, col, normalise_missing, require
from vistrata.operators.association import dense_cells
from vistrata.operators.ordered import running_totals


def _pairs(df: DataFrame, label: str, prediction: str) -> DataFrame:
    require(df, label, prediction)
    return normalise_missing(df).select(
        col(label).alias("label"), col(prediction).alias("prediction")
    ).na.drop()


# -- classification -------------------------------------------------------------------


def eval_classification(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: n, accuracy and support-weighted precision, recall and F1.

    Everything follows from the confusion counts, so the rows are read once and
    only (label, prediction) counts are shuffled.
    """
    cells = _pairs(df, label, prediction).groupBy("label", "prediction").agg(
        F.count("*").alias("n")
    )
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("label").alias("c"), F.col("n").alias("support"),
                 F.lit(0).cast("long").alias("predicted"), hit.cast("long").alias("hits")),
        F.struct(F.col("prediction").alias("c"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")),
    )
    by_class = cells.select(F.explode(sides).alias("s")).groupBy("s.c").agg(
        *[F.sum(f"s.{name}").alias(name) for name in ("support", "predicted", "hits")]
    )
    zero = F.lit(0.0)
    precision = F.coalesce(F.col("hits") / F.nullif(F.col("predicted"), F.lit(0)), zero)
    recall = F.coalesce(F.col("hits") / F.nullif(F.col("support"), F.lit(0)), zero)
    f1 = F.coalesce(2 * precision * recall / F.nullif(precision + recall, zero), zero)
    total = F.nullif(F.sum("support"), F.lit(0))

    def weighted(score):
        return r4(F.sum(score * F.col("support")) / total)

    return by_class.agg(
        F.coalesce(F.sum("support"), F.lit(0)).alias("n"),
        r4(F.sum("hits") / total).alias("accuracy"),
        weighted(precision).alias("precision_weighted"),
        weighted(recall).alias("recall_weighted"),
        weighted(f1).alias("f1_weighted"),
    )


def confusion_matrix(
    df: DataFrame, label: str, prediction: str, classes: list | None = None
) -> DataFrame:
    """``actual, predicted, n``: the cells that occur, or all cells over ``classes``."""
    cells = _pairs(df, label, prediction).groupBy(
        F.col("label").alias("x"), F.col("prediction").alias("y")).agg(F.count("*").alias("n"))
    if classes is not None:
        # Every listed class is an actual one too, if only with zeros.
        none = df.sparkSession.createDataFrame(
            [(str(c), str(c), 0) for c in dict.fromkeys(classes)], "x string, y string, n long")
        texts = cells.select(F.col("x").cast("string"), F.col("y").cast("string"), "n")
        both = texts.unionByName(none).groupBy("x", "y").agg(F.sum("n").alias("n"))
        cells = dense_cells(both, classes)
    return cells.select(
        F.col("x").cast("string").alias("actual"), F.col("y").cast("string").alias("predicted"), "n")


def _score_steps(df: DataFrame, label: str, score: str, positive: Any):
    """Positive and negative counts per distinct score with their running totals."""
    require(df, label, score)
    rows = normalise_missing(df).select(
        col(label).alias("label"), as_double(df, score).alias("score")
    ).na.drop()
    if positive is None:
        classes = [r[0] for r in rows.select("label").distinct().orderBy("label").limit(3).collect()]
        if len(classes) != 2:
            raise ValueError("a ROC curve needs exactly two classes")
        positive = classes[1]
    hit = F.col("label") == F.lit(positive)
    steps = rows.groupBy("score").agg(
        F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg")
    )
    total = fit_scalars(rows, {
        "pos": F.count_if(hit), "neg": F.count_if(~hit),
        "scores": F.approx_count_distinct("score"),
    })
    ordered = running_totals(steps, ["score"], ["pos", "neg"], total["scores"], descending=True)
    return ordered, total


def roc_points(
    df: DataFrame, label: str, score: str, positive: Any = None, drop_collinear: bool = True
) -> DataFrame:
    """``threshold, fpr, tpr`` by descending score, starting at (0, 0).

    The positive class is the larger of the two labels unless given. Inner points
    on a straight line between their neighbours are dropped.
    """
    steps, total = _score_steps(df, label, score, positive)
    if drop_collinear:
        is_end = (F.col("before_pos") + F.col("before_neg") == 0) | F.col("next_pos").isNull()
        turns = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        steps = steps.filter(is_end | turns)
    negatives, positives = float(total["neg"]), float(total["pos"])
    points = steps.select(
        F.col("score").alias("threshold"),
        ((F.col("before_neg") + F.col("neg")) / F.lit(negatives)).alias("fpr"),
        ((F.col("before_pos") + F.col("pos")) / F.lit(positives)).alias("tpr"),
    )
    start = df.sparkSession.createDataFrame(
        [(None, 0.0, 0.0)], "threshold double, fpr double, tpr double"
    )
    return start.unionByName(points)


def roc_auc(df: DataFrame, label: str, score: str, positive: Any = None) -> DataFrame:
    """``roc_auc`` by the trapezoid rule, equal scores taken together."""
    steps, total = _score_steps(df, label, score, positive)
    area = F.sum(F.col("neg") * (F.col("before_pos") + F.col("pos") / F.lit(2.0)))
    whole = F.lit(float(total["pos"]) * float(total["neg"]))
    return steps.agg(r4(area / F.nullif(whole, F.lit(0.0))).alias("roc_auc"))


# -- regression -----------------------------------------------------------------------


def _numeric_pairs(df: DataFrame, label: str, prediction: str) -> DataFrame:
    require(df, label, prediction)
    return normalise_missing(df).select(
        as_double(df, label).alias("y"), as_double(df, prediction).alias("p")
    ).na.drop()


def eval_regression(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: n, mae, mse, rmse, r2 and mape (a zero label divides by 1)."""
    y, p = F.col("y"), F.col("p")
    error = y - p
    squared = F.sum(error * error)
    spread = F.var_pop(y) * F.count(F.lit(1))
    r2 = F.when(spread > 0, 1 - squared / F.nullif(spread, F.lit(0.0))).otherwise(
        F.when(squared == 0, 1.0).otherwise(0.0)
    )
    scale = F.when(y == 0, 1.0).otherwise(y)
    return _numeric_pairs(df, label, prediction).agg(
        F.count(F.lit(1)).alias("n"),
        r4(F.avg(F.abs(error))).alias("mae"),
        r4(F.avg(error * error)).alias("mse"),
        r4(F.sqrt(F.avg(error * error))).alias("rmse"),
        r4(r2).alias("r2"),
        r4(F.avg(F.abs(error / scale)) * 100).alias("mape"),
    )


def residuals(df: DataFrame, label: str, prediction: str, keep: list[str] = ()) -> DataFrame:
    """``y_test, y_pred, residual`` per row, after the columns to keep."""
    require(df, label, prediction, *keep)
    y, p = as_double(df, label), as_double(df, prediction)
    return normalise_missing(df).select(
        *[col(c) for c in keep], y.alias("y_test"), p.alias("y_pred"), (y - p).alias("residual")
    )


def identity_bounds(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Joint range of labels and predictions: the ends of the identity line."""
    return _numeric_pairs(df, label, prediction).agg(
        F.least(F.min("y"), F.min("p")).alias("low"),
        F.greatest(F.max("y"), F.max("p")).alias("high"),
    )
