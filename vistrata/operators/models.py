"""Model registry, training, cross-validation, comparison and prediction on MLlib."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, functions as F

from vistrata.functions.aggregates import fit_scalars, r4, union_all
from vistrata.functions.columns import as_double, col, normalise_missing, require
from vistrata.operators import dual, evaluate, gram, trees
from vistrata.operators.features import check_problem_type, complete_rows
from vistrata.operators.kernel import RandomFourierFeatures
from vistrata.operators.knn import average, nearest_neighbours, vote
from vistrata.operators.split import (
    SEED, Prepared, fold_of, input_names, mark_test, prepare,
)
from vistrata.plans.session import materialise

MAX_ITERATIONS = 1_000
TREES = 100
# Features that a forest selects.
TOP_FEATURES = 10
BOOSTING_ROUNDS, BOOSTING_DEPTH, BOOSTING_STEP = 100, 3, 0.1
NEIGHBOURS = 5
KERNEL_FEATURES = 256


@dataclass
class FitContext:
    """What estimator settings depend on, aggregated once per fit."""

    n: int
    label_std: float


# MLlib minimises mean loss + regParam * penalty on unscaled features; a penalty
# weight of 1 on the summed loss becomes 1/n. Ridge needs the label's standard
# deviation because the solver works on a scaled label.
CLASSIFIERS: dict[str, Callable[[FitContext, dict], Any]] = {
    "Logistic Regression": lambda c, p: LogisticRegression(
        maxIter=p.get("max_iter", MAX_ITERATIONS), regParam=1.0 / c.n, standardization=False,
        weightCol="_n"),
    "Random Forest": lambda c, p: None,
    "Gradient Boosting": lambda c, p: None,
    "Decision Tree": lambda c, p: None,
    "KNN": lambda c, p: None,
    "SVM": lambda c, p: None,
}
REGRESSORS: dict[str, Callable[[FitContext, dict], Any]] = {
    "Linear Regression": lambda c, p: LinearRegression(
        regParam=0.0, solver="normal", weightCol="_n"),
    "Ridge": lambda c, p: LinearRegression(
        regParam=p.get("alpha", 1.0) * c.label_std / c.n, elasticNetParam=0.0,
        standardization=False, solver="normal", weightCol="_n"),
    "Lasso": lambda c, p: LinearRegression(
        regParam=p.get("alpha", 1.0), elasticNetParam=1.0, standardization=False,
        maxIter=MAX_ITERATIONS, tol=1e-9, weightCol="_n"),
    "Random Forest": lambda c, p: None,
    "Gradient Boosting": lambda c, p: None,
    "Decision Tree": lambda c, p: None,
    "KNN": lambda c, p: None,
    "SVR": lambda c, p: None,
}
KERNEL_MODELS = ("SVM", "SVR")
# Models that are not MLlib's: trees and support vectors of all fits share one table
# (``trees``, ``dual``), and the folds of linear models follow from sums of products (``gram``).
TREE_MODELS = ("Random Forest", "Gradient Boosting", "Decision Tree")
LINEAR_MODELS = ("Linear Regression", "Ridge", "Lasso")


@dataclass(frozen=True)
class ModelFamily:
    """The models of one problem type by name."""

    kind: str
    members: dict[str, Callable[[FitContext, dict], Any]]

    def names(self) -> list[str]:
        return [*self.members]

    def settings(self, name: str) -> Callable[[FitContext, dict], Any]:
        try:
            return self.members[name]
        except KeyError:
            known = ", ".join(self.members)
            raise ValueError(f"no {self.kind} model is called {name!r}; there are {known}") from None


REGISTRY = {kind: ModelFamily(kind, members) for kind, members in (
    ("classification", CLASSIFIERS), ("regression", REGRESSORS))}


def available_models(problem_type: str) -> list[str]:
    check_problem_type(problem_type)
    return REGISTRY[problem_type].names()


# -- fitted models --------------------------------------------------------------------


@dataclass
class NeighbourModel:
    """The training table of a nearest-neighbour model."""

    table: DataFrame
    inputs: list[str]
    classes: int
    k: int = NEIGHBOURS
    # Mean and standard deviation per input when features are scaled.
    scaling: list[tuple[float, float]] | None = None

    def vector(self) -> Column:
        scaling = self.scaling or [(0.0, 1.0)] * len(self.inputs)
        return F.array(*[
            (F.col(c) - mean) / (std or 1.0) for c, (mean, std) in zip(self.inputs, scaling)
        ])

    def transform(self, df: DataFrame) -> DataFrame:
        # Equal rows have the same neighbours and are asked once.
        asked = materialise(df.groupBy(*self.inputs).agg(F.count(F.lit(1)).alias("_n")).drop(
            "_n").withColumn("_qid", F.monotonically_increasing_id()), "knn-input")
        train = self.table.select(F.col("_row").alias("id"), self.vector().alias("vec"), "label")
        queries = asked.select(F.col("_qid").alias("qid"), self.vector().alias("vec"))
        near = nearest_neighbours(train, queries, self.k)
        if not self.classes:
            found = average(near)
        else:
            labels = F.array(*[F.lit(float(i)) for i in range(self.classes)])
            shares = near.groupBy("qid").agg(F.collect_list("label").alias("near"))
            shares = shares.select("qid", F.transform(labels, lambda c: F.size(
                F.filter("near", lambda x: x == c)) / F.size("near")).alias("_probability"))
            found = vote(near).drop("votes").join(shares, "qid")
        answers = materialise(asked.join(found, F.col("_qid") == F.col("qid")).drop(
            "_qid", "qid"), "knn-answers")
        return df.join(answers, self.inputs, "left")


@dataclass
class TrainedModel:
    model_name: str
    problem_type: str
    target: str
    feature_cols: list[str]
    classes: list | None
    numeric_target: bool
    fitted: PipelineModel | NeighbourModel | trees.GrownModel
    scaled: bool = False
    train_samples: int = 0
    test_samples: int = 0
    metrics: dict[str, float] = field(default_factory=dict)
    cv_scores: dict[str, Any] = field(default_factory=dict)
    feature_importance: list[tuple[str, float]] = field(default_factory=list)
    # Test rows with ``label, prediction`` (class codes) and ``score`` if there is one.
    test_predictions: DataFrame | None = None

    def importance_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.feature_importance, "feature string, importance double")

    def confusion(self) -> DataFrame:
        named = self.test_predictions.select(
            self._label(F.col("label")).alias("label"),
            self._label(F.col("prediction")).alias("prediction"))
        return evaluate.confusion_matrix(named, "label", "prediction", self.classes)

    def roc(self) -> DataFrame:
        return evaluate.roc_points(self.test_predictions, "label", "score", 1.0)

    def residuals(self) -> DataFrame:
        return evaluate.residuals(self.test_predictions, "label", "prediction")

    def _label(self, code: Column) -> Column:
        values = F.array(*[F.lit(str(c)) for c in self.classes])
        return F.element_at(values, code.cast("int") + 1)

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` (and ``prediction_label``, ``probabilities``) to the rows.

        ``class_labels`` names the classes in the order of the probabilities. A missing feature counts as 0 here, although training leaves such rows out.
        """
        require(df, *self.feature_cols)
        inputs = input_names(self.feature_cols)
        clean = normalise_missing(df).withColumns({
            i: F.coalesce(as_double(df, c), F.lit(0.0)) for c, i in zip(self.feature_cols, inputs)
        })
        scored = score(self.fitted, clean)
        kept = [col(c) for c in df.columns]
        if self.classes is None:
            return scored.select(*kept, "prediction")
        code = F.col("prediction")
        if self.numeric_target:
            value = F.element_at(F.array(*[F.lit(float(c)) for c in self.classes]),
                                 code.cast("int") + 1)
        else:
            value = code
        extra = []
        if "_probability" in scored.columns:
            labels = F.array(*[F.lit(str(c)) for c in self.classes])
            extra = [F.col("_probability").alias("probabilities"), labels.alias("class_labels")]
        if self.problem_type == "classification":
            extra.insert(0, self._label(code).alias("prediction_label"))
        return scored.select(*kept, value.alias("prediction"), *extra)


def score(fitted: PipelineModel | NeighbourModel | trees.GrownModel, df: DataFrame) -> DataFrame:
    """Apply a fitted model; ``_probability`` is an array where the model has one.

    The random features of a kernel model are not made columns on the way.
    """
    if isinstance(fitted, PipelineModel) and len(fitted.stages) > 1 and isinstance(
            fitted.stages[-2], RandomFourierFeatures):
        lifted = PipelineModel(fitted.stages[:-2]).transform(df)
        scored = dual.score_lifted(lifted, *fitted.stages[-2:])
    else:
        scored = fitted.transform(df)
    if "probability" in scored.columns:
        scored = scored.withColumn("_probability", vector_to_array("probability"))
    internal = ["raw_features", "scaled_features", "features", "rawPrediction", "probability",
                "margin", "margin_raw", "margin_prediction"]
    return scored.drop(*internal)


# -- fitting --------------------------------------------------------------------------


def _counted(rows: DataFrame, data: Prepared, *parts: str) -> DataFrame:
    """The distinct rows (of each of ``parts``) with their number ``_n``.

    MLlib passes over its rows once an iteration, and weighs a row that occurs often.
    """
    counts = rows.groupBy(*data.inputs, "label", *parts).agg(F.count(F.lit(1)).alias("_n"))
    return materialise(counts, "counted-rows")


def _context(counted: DataFrame) -> FitContext:
    n, y = F.col("_n"), F.col("label")
    seen = fit_scalars(counted, {"n": F.sum(n), "mean": F.sum(n * y) / F.sum(n)})
    if not seen["n"]:
        raise ValueError("no complete rows to train on")
    away = y - F.lit(seen["mean"])
    std = fit_scalars(counted, {"std": F.sqrt(F.sum(n * away * away) / F.lit(seen["n"]))})["std"]
    return FitContext(seen["n"], std or 1.0)


def fit(
    train: DataFrame, data: Prepared, model_name: str, scale_features: bool = False,
    params: dict | None = None, counted: DataFrame | None = None,
) -> PipelineModel | NeighbourModel | trees.GrownModel:
    """Fit one model on prepared rows. Scaling is part of the fitted model.

    Trees do not depend on the scale of an input and so leave it as it is. ``counted`` are
    the distinct rows with their number ``_n``, where they are known.
    """
    settings, params = REGISTRY[data.problem_type].settings(model_name), params or {}
    if model_name == "KNN":
        return _fit_neighbours(train, data, scale_features, params)
    if model_name in TREE_MODELS:
        table = trees.Table.of(
            train.withColumn("_part", F.lit(0)), data.inputs, _class_count(data))
        if not table.n:
            raise ValueError("no complete rows to train on")
        return _grow(table, model_name, params, frozenset([0]), {})[0]
    if model_name in KERNEL_MODELS:
        alone = replace(data, rows=train, shared={})
        solution, _ = _support_vectors(alone, train, 0, scale_features, params, True)
        return _kernel_pipeline(train, data, solution, scale_features)
    counted = _counted(train, data) if counted is None else counted
    context = _context(counted)
    stages = [VectorAssembler(inputCols=data.inputs, outputCol="raw_features")]
    current = "raw_features"
    if scale_features:
        # A scaler knows no weights and sees the rows themselves.
        scaler = StandardScaler(
            inputCol=current, outputCol="scaled_features", withMean=True, withStd=True)
        stages.append(scaler.fit(stages[0].transform(train)))
        current = "scaled_features"
    stages.append(VectorAssembler(inputCols=[current], outputCol="features"))
    stages.append(settings(context, params))
    return Pipeline(stages=stages).fit(counted)


def _class_count(data: Prepared) -> int:
    return len(data.classes) if data.problem_type == "classification" else 0


def _grow(table: trees.Table, model_name: str, params: dict, learn: frozenset | None,
          folds: dict[int, tuple[frozenset, frozenset]]
          ) -> tuple[trees.GrownModel | None, dict[int, float]]:
    """A tree model of the parts ``learn``, if given, and the scores of the folds."""
    depth = params.get("depth", BOOSTING_DEPTH if model_name == "Gradient Boosting" else None)
    if model_name == "Gradient Boosting":
        # The whole fit and all folds are boosted together.
        fits = {k: v for k, v in folds.items()} | ({} if learn is None else {-1: (learn, None)})
        models, scores = trees.boost(
            table, fits, params.get("rounds", BOOSTING_ROUNDS), trees.Rules(depth), BOOSTING_STEP)
        return models.get(-1), scores
    n, bootstrap, features = 1, False, None
    if model_name == "Random Forest":
        n, bootstrap = params.get("trees", TREES), True
        features = max(1, math.isqrt(len(table.inputs))) if table.classes else None
    how = (n, trees.Rules(depth, features), bootstrap, SEED)
    model = None if learn is None else trees.grow_forest(table, learn, *how)
    return model, trees.forest_scores(table, folds, *how) if folds else {}


def _kernel_settings(moments: gram.Moments, scaled: bool, params: dict) -> dual.Settings:
    """The width of the kernel from the spread of all inputs, and their scaling."""
    means, products = moments.centred()
    n, k = max(moments.n, 1), len(means) - 1
    size = params.get("size", KERNEL_FEATURES)
    if scaled:
        spread = (products.diagonal()[:k] / max(n - 1, 1)) ** 0.5
        scaling = tuple(zip((moments.middle + means)[:k].tolist(),
                            [float(s) if s > 0 else 1.0 for s in spread]))
        return dual.Settings(size, 1.0 / k, SEED, scaling)
    centre = (moments.middle + means)[:k]
    variance = float((products.diagonal()[:k] / n + centre**2).mean() - centre.mean() ** 2)
    return dual.Settings(size, 1.0 / (k * variance) if variance > 0 else 1.0, SEED)


def _kernel_pipeline(train: DataFrame, data: Prepared,
                     solution: dual.Solution | dual.PairModel, scaled: bool) -> PipelineModel:
    """The solution as stages that can be stored."""
    assembler = VectorAssembler(inputCols=data.inputs, outputCol="raw_features")
    stages, current = [assembler], "raw_features"
    if scaled:
        scaler = StandardScaler(inputCol=current, outputCol="scaled_features", withMean=True,
                                withStd=True)
        stages.append(scaler.fit(assembler.transform(train)))
        current = "scaled_features"
    how = solution.settings
    stages.append(RandomFourierFeatures(
        inputCol=current, outputCol="features", size=how.size, gamma=how.gamma, seed=how.seed))
    return PipelineModel([*stages, solution.stage("features")])


def _support_vectors(data: Prepared, rows: DataFrame, folds: int, scaled: bool, params: dict,
                     with_main: bool
                     ) -> tuple[dual.Solution | dual.PairModel | None, list[float]]:
    """The solution of the training rows, if asked for, and the scores of the folds.

    All fits are solved side by side, on one table of distinct rows.
    """
    table = _tree_table(data, rows, folds)
    key = ("moments by part", folds, "_test" in rows.columns)
    if key not in data.shared:
        data.shared[key] = gram.moments_by_part(
            table.frame, data.inputs, F.col("_part"), F.col("_count"))
    moments = data.shared[key]

    def fit_of(learn: frozenset, scored: frozenset | None):
        known = [m for p, m in moments.items() if p in learn]
        if not known:
            raise ValueError("no complete rows to train on")
        total = known[0]
        for more in known[1:]:
            total = total + more
        return learn, scored, _kernel_settings(total, scaled, params)

    fits = {i: fit_of(*fold) for i, fold in _folds_of_parts(folds).items()}
    if with_main:
        fits[-1] = fit_of(frozenset(2 * i for i in range(max(folds, 1))), None)
    if data.problem_type == "classification":
        found, scores = dual.classify_all(table, fits)
        return found.get(-1), [scores.get(i) for i in range(folds if folds >= 2 else 0)]
    found = dual.fit_all(table, fits)
    return found.get(-1), [found[i].score for i in sorted(found) if i >= 0]


def _tree_table(data: Prepared, rows: DataFrame, folds: int) -> trees.Table:
    """The shared table of marked rows; part 2 * fold, and 1 more for test rows."""
    split = "_test" in rows.columns
    key = ("trees", folds, split)
    if key not in data.shared:
        test = F.col("_test").cast("int") if split else F.lit(0)
        fold = fold_of(folds) if folds >= 2 else F.lit(0)
        marked = rows.withColumn("_part", fold * 2 + test)
        data.shared[key] = trees.Table.of(marked, data.inputs, _class_count(data))
    return data.shared[key]


def _folds_of_parts(folds: int) -> dict[int, tuple[frozenset, frozenset]]:
    """What each fold learns from and scores, in parts of the shared table."""
    if folds < 2:
        return {}
    parts = {i: frozenset([2 * i, 2 * i + 1]) for i in range(folds)}
    return {i: (frozenset().union(*(p for j, p in parts.items() if j != i)), parts[i])
            for i in range(folds)}


def _fit_neighbours(train, data: Prepared, scaled: bool, params: dict) -> NeighbourModel:
    scaling = None
    if scaled:
        seen = fit_scalars(
            train, {f"m{c}": F.avg(c) for c in data.inputs}
            | {f"s{c}": F.stddev_samp(c) for c in data.inputs})
        scaling = [(seen[f"m{c}"], seen[f"s{c}"] or 1.0) for c in data.inputs]
    classes = len(data.classes) if data.problem_type == "classification" else 0
    table = train.select("_row", *data.inputs, "label")
    return NeighbourModel(table, data.inputs, classes, params.get("k", NEIGHBOURS), scaling)


def _estimator_model(fitted):
    """The fitted estimator of a pipeline: its last stage, before any probability scaling."""
    if isinstance(fitted, (NeighbourModel, trees.GrownModel)):
        return None
    kinds = (VectorAssembler, StandardScalerModel, RandomFourierFeatures)
    return next(s for s in fitted.stages if not isinstance(s, kinds))


def importance(fitted, features: list[str]) -> list[tuple[str, float]]:
    """Impurity importances, or absolute coefficients where there is one per feature."""
    model = _estimator_model(fitted)
    if isinstance(fitted, trees.GrownModel):
        values = fitted.importances()
    elif isinstance(model, LogisticRegressionModel):
        values = model.coefficientMatrix.toArray().ravel()
    elif isinstance(model, LinearRegressionModel):
        values = model.coefficients.toArray()
    else:
        values = []
    kernel = model and any(isinstance(s, RandomFourierFeatures) for s in fitted.stages)
    if kernel or len(values) != len(features):
        return []
    ranked = sorted(zip(features, map(abs, values)), key=lambda pair: -pair[1])
    return [(name, round(float(v), 6)) for name, v in ranked]


def coefficients(model: TrainedModel, spark) -> DataFrame:
    """``term, value`` of a linear model: intercept and one coefficient per feature."""
    found = _estimator_model(model.fitted)
    terms = [("intercept", float(found.intercept))]
    terms += list(zip(model.feature_cols, found.coefficients.toArray().tolist()))
    return spark.createDataFrame(terms, "term string, value double")


def _evaluate(scored: DataFrame, data: Prepared) -> dict[str, float]:
    if data.problem_type == "classification":
        metrics = evaluate.eval_classification(scored, "label", "prediction").first().asDict()
        if "score" in scored.columns:
            seen = scored.select("label").distinct().limit(3).count()
            if seen == 2:
                auc = evaluate.roc_auc(scored, "label", "score", 1.0).first()[0]
                metrics["roc_auc"] = auc
    else:
        metrics = evaluate.eval_regression(scored, "label", "prediction").first().asDict()
    metrics.pop("n")
    return metrics


def _scored(fitted, rows: DataFrame, data: Prepared) -> DataFrame:
    out = score(fitted, rows)
    kept = [F.col("_row"), F.col("label"), F.col("prediction")]
    if "_probability" in out.columns and len(data.classes or []) == 2:
        kept.append(F.col("_probability")[1].alias("score"))
    return out.select(*kept)


def fit_all(
    df: DataFrame, target: str, model_name: str, problem_type: str = "regression",
    feature_cols: list[str] | None = None, scale_features: bool = False,
    params: dict | None = None,
) -> TrainedModel:
    """Fit on all complete rows, without a test split."""
    check_problem_type(problem_type)
    REGISTRY[problem_type].settings(model_name)
    data = prepare(df, target, problem_type, feature_cols)
    fitted = fit(data.rows, data, model_name, scale_features, params)
    return TrainedModel(
        model_name, problem_type, target, data.feature_cols, data.classes, data.numeric_target,
        fitted, scale_features, data.rows.count(),
        feature_importance=importance(fitted, data.feature_cols))


def train_model(
    df: DataFrame, target: str, model_name: str, problem_type: str = "regression",
    test_size: float = 0.2, feature_cols: list[str] | None = None, scale_features: bool = False,
    cv_folds: int = 5, params: dict | None = None,
) -> TrainedModel:
    """Split, fit, evaluate on the test rows and cross-validate."""
    check_problem_type(problem_type)
    REGISTRY[problem_type].settings(model_name)
    data = prepare(df, target, problem_type, feature_cols)
    marked = mark_test(data, test_size)
    return _train(data, marked, model_name, scale_features, cv_folds, params)


def _train(data, marked, model_name, scale_features, cv_folds, params) -> TrainedModel:
    train, test = marked.filter(~F.col("_test")), marked.filter("_test")
    if model_name in TREE_MODELS:
        table = _tree_table(data, marked, cv_folds)
        learn = frozenset(2 * i for i in range(max(cv_folds, 1)))
        fitted, scores = _grow(table, model_name, params or {}, learn, _folds_of_parts(cv_folds))
        cv = _cv_summary([scores[i] for i in sorted(scores)], data) if scores else {}
    elif model_name in KERNEL_MODELS:
        solution, scores = _support_vectors(
            data, marked, cv_folds, scale_features, params or {}, True)
        fitted = _kernel_pipeline(train, data, solution, scale_features)
        cv = _cv_summary(scores, data)
    else:
        fitted = fit(train, data, model_name, scale_features, params)
        cv = cross_validate(data, model_name, cv_folds, scale_features, params)
    scored = materialise(_scored(fitted, test, data), "test-predictions")
    sizes = fit_scalars(
        marked, {"train": F.count_if(~F.col("_test")), "test": F.count_if(F.col("_test"))})
    return TrainedModel(
        model_name, data.problem_type, data.target, data.feature_cols, data.classes,
        data.numeric_target, fitted, scale_features, sizes["train"], sizes["test"],
        _evaluate(scored, data), cv,
        importance(fitted, data.feature_cols), scored)


def cross_validate(
    data: Prepared, model_name: str, folds: int = 5, scale_features: bool = False,
    params: dict | None = None,
) -> dict[str, Any]:
    """Accuracy or R2 per fold, their mean and population standard deviation.

    The folds of trees are grown from one table and those of linear models solved from
    one set of sums; the other models are fitted once per fold, MLlib's on distinct rows.
    """
    if folds < 2:
        return {}
    if model_name in TREE_MODELS:
        table = _tree_table(data, data.rows, folds)
        _, scores = _grow(table, model_name, params or {}, None, _folds_of_parts(folds))
        return _cv_summary([scores[i] for i in sorted(scores)], data)
    if model_name in LINEAR_MODELS:
        key = ("moments", folds)
        if key not in data.shared:
            data.shared[key] = gram.moments_by_part(data.rows, data.inputs, fold_of(folds))
        found = gram.fold_scores(
            data.shared[key], model_name, (params or {}).get("alpha", 1.0), scale_features)
        return _cv_summary([found[i] for i in sorted(found)], data)
    if model_name in KERNEL_MODELS:
        _, scores = _support_vectors(data, data.rows, folds, scale_features, params or {}, False)
        return _cv_summary(scores, data)
    key, rows = ("fold rows", folds), data.rows.withColumn("_fold", fold_of(folds))
    if model_name != "KNN" and not scale_features:
        return _cv_summary(
            _weighted_scores(rows, data, model_name, folds, False, params), data)
    if key not in data.shared:
        # The folds are digests of the rows; every fit scans them several times.
        data.shared[key] = materialise(rows, "fold-rows")
    rows = data.shared[key]
    if model_name == "KNN" and not scale_features:
        return _cv_summary(_neighbour_scores(rows, data, folds, params or {}), data)
    if model_name != "KNN":
        return _cv_summary(
            _weighted_scores(rows, data, model_name, folds, True, params), data)
    scores = []
    for i in range(folds):
        fitted = fit(rows.filter(F.col("_fold") != i), data, model_name, scale_features, params)
        held_out = _scored(fitted, rows.filter(F.col("_fold") == i), data)
        if data.problem_type == "classification":
            found = evaluate.eval_classification(held_out, "label", "prediction")
        else:
            found = evaluate.eval_regression(held_out, "label", "prediction")
        scores.append(found.first()[_cv_metric(data)])
    return _cv_summary(scores, data)


def _weighted_scores(rows: DataFrame, data: Prepared, model_name: str, folds: int,
                     scale_features: bool, params: dict | None) -> list:
    """The accuracy of every fold, fitted and scored on distinct rows with their number."""
    counted, fold, scores = _counted(rows, data, "_fold"), F.col("_fold"), []
    for i in range(folds):
        fitted = fit(rows.filter(fold != i), data, model_name, scale_features, params,
                     counted.filter(fold != i))
        hit = F.when(F.col("label") == F.col("prediction"), F.col("_n")).otherwise(0)
        scores.append(score(fitted, counted.filter(fold == i)).agg(
            r4(F.sum(hit) / F.sum("_n"))).first()[0])
    return scores


def _neighbour_scores(rows: DataFrame, data: Prepared, folds: int, params: dict) -> list:
    """The score of every fold from one search, where neighbours come from other folds."""
    # Rows that differ in their number alone are asked once and count so often.
    counts = materialise(rows.groupBy(*data.inputs, "_fold", "label").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first")), "knn-counts")
    vec = F.array(*data.inputs)
    asked = materialise(counts.groupBy(*data.inputs, "_fold").agg(
        F.min("_first").alias("qid")), "knn-folds")
    near = nearest_neighbours(
        rows.select(F.col("_row").alias("id"), vec.alias("vec"), "label", "_fold"),
        asked.select("qid", vec.alias("vec"), "_fold"),
        params.get("k", NEIGHBOURS), part="_fold")
    found = vote(near) if data.problem_type == "classification" else average(near)
    pairs = counts.join(asked.join(found, "qid").select(
        *data.inputs, "_fold", "prediction"), [*data.inputs, "_fold"])
    y, p, n = F.col("label"), F.col("prediction"), F.col("_n")
    if data.problem_type == "classification":
        score = F.sum(F.when(y == p, n).otherwise(0)) / F.sum(n)
    else:
        pairs = materialise(pairs, "knn-pairs")
        middle = pairs.groupBy("_fold").agg((F.sum(n * y) / F.sum(n)).alias("_middle"))
        pairs, away = pairs.join(F.broadcast(middle), "_fold"), y - F.col("_middle")
        wrong = F.sum(n * (y - p) * (y - p))
        spread = F.when(F.max(y) > F.min(y), F.sum(n * away * away)).otherwise(0.0)
        score = F.when(spread > 0, 1 - wrong / F.nullif(spread, F.lit(0.0))).otherwise(
            F.when(wrong == 0, 1.0).otherwise(0.0))
    by_fold = {r["_fold"]: r["s"] for r in pairs.groupBy("_fold").agg(score.alias("s")).collect()}
    return [by_fold.get(i) for i in range(folds)]


def _cv_metric(data: Prepared) -> str:
    return "accuracy" if data.problem_type == "classification" else "r2"


def _cv_summary(scores: list, data: Prepared) -> dict[str, Any]:
    scores = [round(s, 4) for s in scores if s is not None]
    if not scores:
        return {}
    mean = sum(scores) / len(scores)
    std = math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))
    return {"mean": round(mean, 4), "std": round(std, 4), "scores": scores,
            "scoring": _cv_metric(data)}


def train_many(
    df: DataFrame, target: str, model_names: list[str], problem_type: str = "regression",
    test_size: float = 0.2, feature_cols: list[str] | None = None, scale_features: bool = False,
    cv_folds: int = 5, params: dict[str, dict] | None = None,
) -> dict[str, TrainedModel | Exception]:
    """Every model by its name, or the error that it failed with.

    All models share one prepared table, one split, the distinct rows that trees grow on
    and the sums that linear folds come from.
    """
    check_problem_type(problem_type)
    data = prepare(df, target, problem_type, feature_cols)
    marked = mark_test(data, test_size)
    found: dict[str, TrainedModel | Exception] = {}
    for name in model_names:
        try:
            found[name] = _train(
                data, marked, name, scale_features, cv_folds, (params or {}).get(name))
        except Exception as error:  # one failing model must not hide the others
            found[name] = error
    return found


def comparison(spark, found: dict[str, TrainedModel | Exception], problem_type: str) -> DataFrame:
    """One row per model of ``train_many``, best first; a model that failed keeps its error."""
    if problem_type == "classification":
        primary = "accuracy"
        fields = ["accuracy", "f1_weighted", "precision_weighted", "recall_weighted", "roc_auc"]
    else:
        primary, fields = "r2", ["r2", "mae", "mse", "rmse", "mape"]
    results = []
    for name, model in found.items():
        if isinstance(model, Exception):
            error = str(model).split("\n")[0]
            results.append((name, *[None] * len(fields), *[None] * 6, error))
            continue
        cv = model.cv_scores
        results.append((
            name, *[model.metrics.get(f) for f in fields], cv.get("mean"), cv.get("std"),
            cv.get("scores"), model.train_samples, model.test_samples,
            dict(model.feature_importance), None))
    schema = ", ".join([
        "model_name string", *[f"{f} double" for f in fields], "cv_mean double", "cv_std double",
        "cv_scores array<double>", "train_samples long", "test_samples long",
        "feature_importance map<string,double>", "error string"])
    return spark.createDataFrame(results, schema).orderBy(
        F.col(primary).desc_nulls_last(), "model_name")


def compare_models(
    df: DataFrame, target: str, model_names: list[str], problem_type: str = "regression",
    test_size: float = 0.2, feature_cols: list[str] | None = None, scale_features: bool = False,
    cv_folds: int = 5, params: dict[str, dict] | None = None,
) -> DataFrame:
    """One row of metrics, fold scores, sample counts and importances per model, best first.

    A model that fails keeps its error. ``train_many`` has the models themselves, and
    ``compared_rows`` their confusion matrices, ROC curves and residuals.
    """
    found = train_many(df, target, model_names, problem_type, test_size, feature_cols,
                       scale_features, cv_folds, params)
    return comparison(df.sparkSession, found, problem_type)


def compared_rows(found: dict[str, TrainedModel | Exception], what: str) -> DataFrame | None:
    """``model_name`` and the ``confusion``, ``roc`` or ``residuals`` rows of every model.

    Models that failed, and for ``roc`` those without a score, have no rows.
    """
    if what not in ("confusion", "roc", "residuals"):
        raise ValueError("what must be confusion, roc or residuals")
    parts = [
        getattr(model, what)().select(F.lit(name).alias("model_name"), "*")
        for name, model in found.items() if isinstance(model, TrainedModel)
        and (what != "roc" or "score" in model.test_predictions.columns)]
    return union_all(parts) if parts else None


def rf_feature_importance(
    df: DataFrame, target: str, problem_type: str = "regression",
    n_estimators: int = TREES, depth: int | None = None, limit: int | None = None,
    top: int = TOP_FEATURES,
) -> DataFrame:
    """``feature, importance, selected`` of a random forest on all complete rows, best first.

    The ``top`` best features are selected.
    """
    _, features = complete_rows(df, target)
    schema = "feature string, importance double, selected boolean"
    if not features:
        return df.sparkSession.createDataFrame([], schema)
    model = fit_all(df, target, "Random Forest", problem_type, features,
                    params={"trees": n_estimators, "depth": depth})
    ranked = sorted(model.feature_importance, key=lambda pair: (-pair[1], pair[0]))
    rows = [(name, value, i < top) for i, (name, value) in enumerate(ranked)]
    table = df.sparkSession.createDataFrame(rows, schema).orderBy(F.desc("importance"), "feature")
    return table if limit is None else table.limit(limit)
