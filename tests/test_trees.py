"""Trees, forests and boosting on shared tables, and linear folds from sums of products."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from vistrata.operators import gram, models, split, trees
from vistrata.plans.session import scratch_path
from vistrata.sources import modelstore


def stats_of(y, w):
    return np.stack([w, w * y, w * y * y], axis=1)


# ---------------------------------------------------------------- one tree


def brute_tree(x, y, w, depth, most):
    mean = (w * y).sum() / w.sum()
    if (w * (y - mean) ** 2).sum() < 1e-9 or w.sum() < 2 or depth == most:
        return mean
    best = None
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, j] <= cut
            found = sum((w[s] * y[s]).sum() ** 2 / w[s].sum() for s in (low, ~low))
            if best is None or found > best[0] * (1 + 1e-12):
                best = (found, j, cut, low)
    if best is None:
        return mean
    _, j, cut, low = best
    return (j, cut, brute_tree(x[low], y[low], w[low], depth + 1, most),
            brute_tree(x[~low], y[~low], w[~low], depth + 1, most))


def walk(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("depth", [None, 1, 2, 5])
def test_tree_equals_the_recursive_one(depth):
    rng = np.random.default_rng(depth or 0)
    for _ in range(5):
        x = rng.integers(0, 8, (60, 3)).astype(float)
        y, w = rng.integers(0, 10, 60).astype(float), rng.integers(1, 4, 60).astype(float)
        want = brute_tree(x, y, w, 0, depth)
        grown = trees.grow(x, stats_of(y, w), trees.Rules(depth))
        assert grown.predict(x)[:, 0] == pytest.approx([walk(want, r) for r in x])


def test_tree_without_rows_or_cuts():
    none = trees.grow(np.zeros((0, 2)), np.zeros((0, 3)), trees.Rules())
    assert none.predict(np.zeros((2, 2))).tolist() == [[0.0], [0.0]]
    flat = trees.grow(np.ones((4, 2)), stats_of(np.arange(4.0), np.ones(4)), trees.Rules())
    assert flat.feature.tolist() == [-1] and flat.value.tolist() == [[1.5]]


def test_nodes_with_few_features_still_find_a_cut():
    rng = np.random.default_rng(3)
    x = np.column_stack([np.zeros(200), np.zeros(200), rng.normal(size=200)])
    grown = trees.grow(x, stats_of(x[:, 2], np.ones(200)), trees.Rules(features=1))
    assert np.abs(grown.predict(x)[:, 0] - x[:, 2]).max() < 1e-12
    assert grown.importances(3).tolist() == [0, 0, 1]


@pytest.mark.parametrize("count", [1.0, 7.0, 50.0, 400.0])
def test_bootstrap_weights_have_mean_and_spread_of_the_count(count):
    rows = np.arange(20_000, dtype=np.uint64)
    w = trees.bootstrap_weights(rows, np.full(20_000, count), 5)
    assert w.mean() == pytest.approx(count, rel=0.03) and w.var() == pytest.approx(count, rel=0.06)
    assert (w == trees.bootstrap_weights(rows, np.full(20_000, count), 5)).all()
    assert (w != trees.bootstrap_weights(rows, np.full(20_000, count), 6)).any()
    assert not trees.bootstrap_weights(rows, np.zeros(20_000), 5).any()


# ---------------------------------------------------------------- whole fits


@pytest.fixture(scope="module")
def blobs(spark):
    """Three classes and an integer target on a grid of values with repeated rows."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 30, (900, 3)).astype(float)
    kind = np.where(x[:, 0] + x[:, 1] < 25, 0, np.where(x[:, 1] > x[:, 2], 1, 2))
    kind = np.where(rng.uniform(size=900) < 0.1, rng.integers(0, 3, 900), kind)
    y = 5 * x[:, 0] - 3 * (x[:, 1] > 12) * x[:, 1] + rng.integers(0, 4, 900)
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y, "kind": kind})
    pdf = pd.concat([pdf, pdf.iloc[:150]])
    return spark.createDataFrame(pdf).cache()


INPUTS = ["a", "b", "c"]


def prepared(df, target, kind):
    data = split.prepare(df, target, kind, INPUTS)
    return data, models._tree_table(data, split.mark_test(data), 3)


def both_ways(df, target, kind, monkeypatch, run):
    """The result with the whole table in a task, and with tasks of 60 rows."""
    _, small = prepared(df, target, kind)
    assert small.shared is not None
    first = run(small)
    monkeypatch.setattr(trees, "TASK_ROWS", 60)
    monkeypatch.setattr(trees, "HISTOGRAM_CELLS", 5_000)
    _, large = prepared(df, target, kind)
    assert large.shared is None
    return first, run(large)


@pytest.mark.parametrize("target, kind, features", [
    ("y", "regression", None), ("kind", "classification", 1)])
def test_large_tables_grow_the_same_forest(blobs, monkeypatch, target, kind, features):
    folds = models._folds_of_parts(3)

    def run(table):
        how = (3, trees.Rules(features=features), True, 11)
        model = trees.grow_forest(table, frozenset([0, 2, 4]), *how)
        return model, trees.forest_scores(table, folds, *how)

    (a, a_scores), (b, b_scores) = both_ways(blobs, target, kind, monkeypatch, run)
    x = np.random.default_rng(2).integers(0, 30, (500, 3)).astype(float)
    assert a.raw(x) == pytest.approx(b.raw(x), abs=1e-9)
    assert a_scores == pytest.approx(b_scores, abs=1e-9) and min(a_scores.values()) > 0.5
    assert [len(t.feature) for t in a.trees] == [len(t.feature) for t in b.trees]
    assert a.importances() == pytest.approx(b.importances(), abs=1e-9)


@pytest.mark.parametrize("target, kind", [("y", "regression"), ("kind", "classification")])
def test_large_tables_boost_the_same(blobs, monkeypatch, target, kind):
    fits = {-1: (frozenset([0, 2, 4]), None), 0: models._folds_of_parts(3)[0]}

    def run(table):
        return trees.boost(table, fits, 3, trees.Rules(2), 0.3)

    (a, a_scores), (b, b_scores) = both_ways(blobs, target, kind, monkeypatch, run)
    x = np.random.default_rng(2).integers(0, 30, (500, 3)).astype(float)
    assert a[-1].raw(x) == pytest.approx(b[-1].raw(x), abs=1e-6)
    assert a_scores == pytest.approx(b_scores, abs=1e-6)


def test_a_tree_has_no_depth_limit(spark):
    """Alternating labels need a cut between any two rows, and get it."""
    df = spark.range(3_000).selectExpr("id * 1.0D AS a", "(id % 2) * 10.0D AS y")
    model = models.fit_all(df, "y", "Decision Tree", feature_cols=["a"])
    wrong = model.predict(df).agg(F.max(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    assert wrong == 0 and len(model.fitted.trees[0].feature) == 5_999


def test_wide_range_of_values_above_the_task(spark, monkeypatch):
    """One feature with many values: cuts at quantiles above, exact ones below."""
    monkeypatch.setattr(trees, "TASK_ROWS", 200)
    df = spark.range(4_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7.0D ELSE pow(id, 1.5D) END AS a", "id * 1.0D AS y")
    model = models.fit_all(df, "y", "Decision Tree", feature_cols=["a"])
    rows = model.predict(df).filter("a <> 7").agg(F.max(F.abs(F.col("y") - F.col("prediction"))))
    assert rows.first()[0] == pytest.approx(0, abs=1e-9)


def test_three_class_boosting_lowers_the_loss_every_round(blobs):
    data, table = prepared(blobs, "kind", "classification")
    model = trees.boost(table, {-1: (frozenset([0, 2, 4]), None)}, 12, trees.Rules(3), 0.2)[0][-1]
    local = data.rows.toPandas()
    local = split.mark_test(data).filter("NOT _test").toPandas()
    x, y = local[data.inputs].to_numpy(), local["label"].to_numpy(int)
    losses = []
    for rounds in range(1, 13):
        part = trees.GrownModel(model.inputs, 3, model.trees[:3 * rounds], model.start,
                                model.step, 3)
        p = part.raw(x)
        assert p.sum(axis=1) == pytest.approx(1)
        losses.append(-np.log(p[np.arange(len(y)), y]).mean())
    assert (np.diff(losses) < 0).all() and losses[-1] < 0.6 * np.log(3)


def test_stored_trees_predict_the_same(spark, blobs):
    for name in ("Random Forest", "Gradient Boosting"):
        model = models.fit_all(blobs, "kind", name, "classification", INPUTS,
                               params={"trees": 3, "rounds": 3})
        path = scratch_path(spark, "trees-test")
        modelstore.save_model(model, spark, path)
        again = modelstore.load_model(spark, path)
        key = [*INPUTS, "prediction", "probabilities"]
        assert sorted(map(tuple, model.predict(blobs).select(key).collect())) == sorted(
            map(tuple, again.predict(blobs).select(key).collect()))


# ---------------------------------------------------------------- linear folds


def mllib_fold_scores(data, folds, **how):
    out = []
    rows = VectorAssembler(inputCols=data.inputs, outputCol="features").transform(
        data.rows.withColumn("fold", split.fold_of(folds)))
    for i in range(folds):
        n = rows.filter(F.col("fold") != i).count()
        std = rows.filter(F.col("fold") != i).agg(F.stddev_pop("label")).first()[0]
        settings = {k: v(n, std) if callable(v) else v for k, v in how.items()}
        model = LinearRegression(standardization=False, **settings).fit(
            rows.filter(F.col("fold") != i))
        out.append(model.evaluate(rows.filter(F.col("fold") == i)).r2)
    return out


@pytest.mark.parametrize("name, how", [
    ("Linear Regression", {"solver": "normal"}),
    ("Ridge", {"solver": "normal", "regParam": lambda n, std: 30.0 * std / n}),
    ("Lasso", {"elasticNetParam": 1.0, "regParam": 0.3, "tol": 1e-12, "maxIter": 1000})])
def test_folds_equal_mllib(blobs, name, how):
    data = split.prepare(blobs, "y", "regression", INPUTS)
    moments = gram.moments_by_part(data.rows, data.inputs, split.fold_of(4))
    alpha = {"Ridge": 30.0, "Lasso": 0.3}.get(name, 1.0)
    got = gram.fold_scores(moments, name, alpha)
    assert [got[i] for i in range(4)] == pytest.approx(mllib_fold_scores(data, 4, **how), abs=1e-6)


def test_linear_models_share_one_scan(blobs):
    data = split.prepare(blobs, "y", "regression", INPUTS)
    for name in models.LINEAR_MODELS:
        assert models.cross_validate(data, name, 5)["mean"] > 0.5
    assert list(data.shared) == [("moments", 5)]


def test_dependent_and_constant_inputs():
    rng = np.random.default_rng(4)
    x = rng.normal(500, 2, (300, 2))
    x = np.column_stack([x, x[:, 0] - 2 * x[:, 1], np.full(300, 3.0)])
    y = x[:, 0] + rng.normal(size=300)
    middle = np.append(x[0], y[0])
    z = np.column_stack([np.ones(300), np.column_stack([x, y]) - middle])
    line = gram.fit_line("Linear Regression", gram.Moments(z.T @ z, middle))
    want = np.column_stack([np.ones(300), x]) @ np.linalg.lstsq(
        np.column_stack([np.ones(300), x]), y, rcond=None)[0]
    assert line.intercept + x @ line.coefficients == pytest.approx(want, abs=1e-6)
    assert line.coefficients[3] == 0
    scaled = gram.fit_line("Ridge", gram.Moments(z.T @ z, middle), 5.0, scaled=True)
    live = (x[:, :3] - x[:, :3].mean(axis=0)) / x[:, :3].std(axis=0, ddof=1)
    beta = np.linalg.solve(live.T @ live + 5 * np.eye(3), live.T @ (y - y.mean()))
    assert scaled.coefficients[:3] * x[:, :3].std(axis=0, ddof=1) == pytest.approx(beta, abs=1e-8)
