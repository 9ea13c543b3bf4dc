import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vistrata.operators import chartdata, models, split
from vistrata.plans.inspect import plan_text
from vistrata.plans.session import scratch_path
from vistrata.sources import modelstore

SMALL = {"trees": 10, "rounds": 10, "size": 64, "depth": 5}


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(42)
    x1, x2 = rng.normal(0, 1, 200), rng.normal(5, 2, 200)
    y = 2 * x1 - 1.5 * x2 + rng.normal(0, 0.3, 200)
    rows = [tuple(map(float, r)) for r in zip(x1, x2, y)]
    return spark.createDataFrame(rows, "x1 double, x2 double, y double").cache()


@pytest.fixture(scope="module")
def classes(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (200, 2))
    rows = [(float(a), float(b), int(a + b > 0), "pos" if a + b > 0 else "neg") for a, b in x]
    return spark.createDataFrame(rows, "x1 double, x2 double, label int, name string").cache()


class TestSplit:
    def test_exact_and_stable(self, classes):
        data = split.prepare(classes, "name", "classification", ["x1", "x2"])
        marked = split.mark_test(data, 0.23)
        counts = {r.label: (r.n, r.t) for r in marked.groupBy("label").agg(
            F.count("*").alias("n"), F.count_if("_test").alias("t")).collect()}
        assert sum(t for _, t in counts.values()) == math.ceil(200 * 0.23)
        for n, t in counts.values():
            assert abs(t - 0.23 * n) < 1
        first = {r._row for r in marked.filter("_test").collect()}
        again = {r._row for r in split.mark_test(data, 0.23).filter("_test").collect()}
        assert first == again

    def test_split_does_not_depend_on_the_layout(self, spark):
        df = spark.range(2_000).selectExpr("(id % 700) * 0.5D AS x", "(id % 13) * 1.0D AS y")
        tests = []
        for rows in (df, df.repartition(7), df.orderBy(F.desc("x")).coalesce(1)):
            marked = split.mark_test(split.prepare(rows, "y")).filter("_test")
            tests.append(sorted(tuple(r) for r in marked.select("_f0", "label", "_row").collect()))
        assert len(tests[0]) == 400 and tests[0] == tests[1] == tests[2]

    def test_many_classes(self, spark):
        df = spark.range(3_000).selectExpr("id * 1.0D AS x", "concat('c', id % 1500) AS c")
        data = split.prepare(df, "c", "classification", ["x"])
        assert len(data.classes) == 1_500
        assert data.rows.agg(F.max("label")).first()[0] == 1_499

    def test_frequent_rows_are_written_in_blocks(self, spark, monkeypatch):
        monkeypatch.setattr(split, "COPIES_PER_TASK", 10)
        df = spark.range(95).selectExpr("1.0D AS x", "id % 2 * 1.0D AS y")
        data = split.prepare(df, "y")
        assert data.rows.count() == 95 == data.rows.select("_row").distinct().count()

    def test_few_distinct_rows_are_written_by_many_tasks(self, spark, monkeypatch):
        """The tasks follow from the rows to write, not from the few distinct ones."""
        monkeypatch.setattr(split, "ROWS_PER_TASK", 500)
        df = spark.range(20_000).selectExpr("id % 40 * 1.0D AS x")
        rows = split.with_row_keys(df, ["x"])
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) <= 5_000

    def test_rows_are_not_sorted_by_their_class(self, spark, monkeypatch):
        """A few classes are no key to deal rows over tasks by."""
        plans, write = [], split.materialise

        def seen(df, label):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return write(df, label)

        monkeypatch.setattr(split, "materialise", seen)
        df = spark.range(200).selectExpr("id * 1.0D AS x", "IF(id % 3 = 0, 'a', 'b') AS c")
        data = split.prepare(df, "c", "classification")
        assert data.rows.groupBy("label").count().count() == 2
        assert plans and not any("SortMergeJoin" in p for p in plans)

    def test_hashes_are_computed_once(self, spark):
        """The marked rows hold the split; no scan of them computes a digest again."""
        data = split.prepare(spark.range(300).selectExpr("id * 1.0D AS x", "id % 7 * 1.0D AS y"), "y")
        marked = split.mark_test(data)
        assert "md5" not in marked._jdf.queryExecution().executedPlan().toString().lower()
        assert marked.columns == [*data.rows.columns, "_test"]

    def test_identical_rows_are_split_too(self, spark):
        df = spark.createDataFrame([(1.0, 2.0)] * 100, "x double, y double")
        marked = split.mark_test(split.prepare(df, "y"), 0.25)
        assert marked.filter("_test").count() == 25

    def test_missing_rows_are_left_out(self, spark):
        df = spark.createDataFrame([(1.0, "a"), (None, "b"), (2.0, None), (3.0, "b")],
                                   "x double, c string")
        data = split.prepare(df, "c", "classification")
        assert data.rows.count() == 2 and data.classes == ["a", "b"]

    def test_errors(self, spark, classes):
        with pytest.raises(ValueError):
            split.prepare(classes, "label", "ranking")
        with pytest.raises(ValueError):
            split.prepare(classes.select("label"), "label")
        rare = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (3.0, "b")], "x double, c string")
        with pytest.raises(ValueError):
            split.mark_test(split.prepare(rare, "c", "classification"))

    def test_folds_partition_the_rows(self, regression):
        data = split.prepare(regression, "y")
        sizes = data.rows.groupBy(split.fold_of(5)).count().collect()
        assert len(sizes) == 5 and sum(r["count"] for r in sizes) == 200


class TestTraining:
    @pytest.mark.parametrize("name", models.available_models("regression"))
    def test_regressors(self, regression, name):
        params = dict(SMALL, alpha=0.1) if name == "Lasso" else SMALL
        model = models.train_model(regression, "y", name, cv_folds=0, params=params)
        assert model.train_samples + model.test_samples == 200 and model.test_samples == 40
        assert model.metrics["r2"] > 0.5
        assert model.residuals().count() == 40

    @pytest.mark.parametrize("name", models.available_models("classification"))
    def test_classifiers(self, classes, name):
        model = models.train_model(
            classes, "name", name, "classification", feature_cols=["x1", "x2"], cv_folds=0,
            params=SMALL)
        assert model.metrics["accuracy"] > 0.7 and model.metrics["roc_auc"] > 0.7
        assert sum(r.n for r in model.confusion().collect()) == model.test_samples
        out = model.predict(classes)
        assert {r[0] for r in out.select("prediction_label").distinct().collect()} <= {"neg", "pos"}
        for row in out.select("probabilities").limit(20).collect():
            assert sum(row.probabilities) == pytest.approx(1)

    def test_three_classes(self, spark):
        rng = np.random.default_rng(1)
        x = rng.normal(0, 0.4, (240, 2)) + np.repeat([[0, 0], [3, 0], [0, 3]], 80, axis=0)
        rows = [(float(a), float(b), 10 * (i // 80)) for i, (a, b) in enumerate(x)]
        df = spark.createDataFrame(rows, "a double, b double, y int")
        for name in ("Gradient Boosting", "SVM", "KNN", "Logistic Regression"):
            model = models.train_model(df, "y", name, "classification", cv_folds=0,
                                       params=dict(SMALL, rounds=2, max_iter=20))
            assert model.metrics["accuracy"] > 0.9 and "roc_auc" not in model.metrics
            found = {r[0] for r in model.predict(df).select("prediction").distinct().collect()}
            assert found == {0.0, 10.0, 20.0}

    def test_svm_separates_a_ring(self, spark):
        rng = np.random.default_rng(4)
        x = rng.uniform(-2, 2, (600, 2))
        rows = [(float(a), float(b), int(a * a + b * b < 1.5)) for a, b in x]
        df = spark.createDataFrame(rows, "a double, b double, y int")
        model = models.train_model(df, "y", "SVM", "classification", cv_folds=0)
        assert model.metrics["accuracy"] > 0.9

    def test_ridge_and_lasso_closed_forms(self, spark):
        x = np.arange(10.0)
        y = 3 * x + np.sin(x)
        df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
        sxx = ((x - x.mean()) ** 2).sum()
        sxy = ((x - x.mean()) * (y - y.mean())).sum()
        want = {"Linear Regression": sxy / sxx, "Ridge": sxy / (sxx + 1),
                "Lasso": (sxy / 10 - 1) / (sxx / 10)}
        for name, slope in want.items():
            terms = dict(models.coefficients(models.fit_all(df, "y", name), spark).collect())
            assert terms["x"] == pytest.approx(slope, rel=1e-6)

    def test_cross_validation(self, regression):
        model = models.train_model(regression, "y", "Linear Regression", cv_folds=3)
        cv = model.cv_scores
        assert len(cv["scores"]) == 3 and cv["scoring"] == "r2" and cv["mean"] > 0.9
        assert cv["std"] == pytest.approx(np.std(cv["scores"]), abs=1e-4)

    def test_comparison_has_the_fold_scores(self, regression):
        names = ["Linear Regression", "No Such Model"]
        good, bad = models.compare_models(regression, "y", names).collect()
        assert len(good.cv_scores) == 5 and bad.cv_scores is None
        assert good.cv_mean == pytest.approx(np.mean(good.cv_scores), abs=1e-4)

    def test_registered_models_are_whole(self, spark, monkeypatch):
        queries, sf_dir = entry.queries(), "/root/testdata/sf0.001"
        table = queries["model_linear_regression"](spark, sf_dir).collect()
        assert [r.metric for r in table if r.metric.startswith("cv_")] == [
            "cv_mean", "cv_std", *[f"cv_fold_{i}" for i in range(5)]]
        calls = []
        monkeypatch.setattr(models, "compare_models", lambda df, target, names, **how: (
            calls.append((names, how.get("cv_folds", 5)))))
        queries["compare_models"](spark, sf_dir)
        assert calls == [(models.available_models("regression"), 5)] and len(calls[0][0]) == 8

    def test_scaling_keeps_a_linear_fit(self, regression):
        plain = models.train_model(regression, "y", "Linear Regression", cv_folds=0)
        scaled = models.train_model(
            regression, "y", "Linear Regression", cv_folds=0, scale_features=True)
        assert plain.metrics == pytest.approx(scaled.metrics, abs=1e-3)

    def test_importance(self, regression):
        rows = models.rf_feature_importance(regression, "y", n_estimators=10).collect()
        assert rows[0].feature == "x2" and sum(r.importance for r in rows) == pytest.approx(1, abs=1e-4)

    def test_unknown_model(self, regression):
        with pytest.raises(ValueError):
            models.train_model(regression, "y", "No Such Model")

    def test_compare(self, regression):
        table = models.compare_models(
            regression, "y", ["No Such Model", "Lasso", "Linear Regression"], cv_folds=0)
        rows = table.collect()
        assert [r.model_name for r in rows] == ["Linear Regression", "Lasso", "No Such Model"]
        assert rows[-1].error and rows[-1].r2 is None
        best = {r.model_name: r.best for r in chartdata.model_comparison(table, "r2").collect()}
        assert best == {"Linear Regression": True, "Lasso": False}


class TestPredictAndStore:
    @pytest.mark.parametrize("arrow", ["true", "false"])
    def test_trees_are_stored_with_and_without_arrow(self, spark, regression, arrow):
        """A session of its own settings has Arrow off; plain Python floats pass both ways."""
        name = "spark.sql.execution.arrow.pyspark.enabled"
        before = spark.conf.get(name)
        spark.conf.set(name, arrow)
        try:
            model = models.fit_all(regression, "y", "Decision Tree", params={"depth": 3})
            path = scratch_path(spark, "model-test")
            modelstore.save_model(model, spark, path)
            again = modelstore.load_model(spark, path)
            found = [[r.prediction for r in m.predict(regression).collect()] for m in (model, again)]
        finally:
            spark.conf.set(name, before)
        assert found[0] == found[1]

    def test_missing_features_count_as_zero(self, spark, regression):
        model = models.fit_all(regression, "y", "Linear Regression")
        df = spark.createDataFrame([(None, 1.0), (0.0, 1.0)], "x1 double, x2 double")
        a, b = [r.prediction for r in model.predict(df).collect()]
        assert a == b

    @pytest.mark.parametrize("name", ["Linear Regression", "Random Forest", "KNN", "SVR"])
    def test_round_trip(self, spark, regression, name):
        model = models.fit_all(regression, "y", name, scale_features=True, params=SMALL)
        path = scratch_path(spark, "model-test")
        modelstore.save_model(model, spark, path)
        again = modelstore.load_model(spark, path)
        assert (again.model_name, again.feature_cols) == (name, ["x1", "x2"])
        key = ["x1", "x2"]
        before = {tuple(r[c] for c in key): r.prediction for r in model.predict(regression).collect()}
        after = {tuple(r[c] for c in key): r.prediction for r in again.predict(regression).collect()}
        assert before == pytest.approx(after)


class TestRepeatedRows:
    """MLlib models pass over the distinct rows, which count as often as they occur."""

    @pytest.fixture(scope="class")
    def grid(self, spark):
        rng = np.random.default_rng(5)
        a, b = rng.integers(0, 6, 600).astype(float), rng.integers(0, 4, 600).astype(float)
        rows = [(float(x), float(y), float(2 * x - y + (i % 3)), "hi" if x + y + i % 3 > 5 else "lo")
                for i, (x, y) in enumerate(zip(a, b))]
        return spark.createDataFrame(rows, "x1 double, x2 double, y double, name string").cache()

    @pytest.mark.parametrize("name, kind", [
        *[(m, "regression") for m in models.LINEAR_MODELS], ("Logistic Regression", "classification")])
    def test_solver_sees_distinct_rows(self, grid, monkeypatch, name, kind):
        target = "y" if kind == "regression" else "name"
        seen, solve = [], models.Pipeline.fit

        def fit(pipeline, df):
            seen.append(df.count())
            return solve(pipeline, df)

        monkeypatch.setattr(models.Pipeline, "fit", fit)
        models.train_model(grid, target, name, kind, feature_cols=["x1", "x2"], cv_folds=3)
        # Each fold has its own.
        assert seen and max(seen) <= 3 * grid.select("x1", "x2", target).distinct().count() < 300

    @pytest.mark.parametrize("scaled", [False, True])
    def test_fold_scores_weigh_copies(self, grid, scaled):
        data = split.prepare(grid, "name", "classification", ["x1", "x2"])
        found = models.cross_validate(data, "Logistic Regression", 3, scaled)["scores"]
        rows = data.rows.withColumn("_fold", split.fold_of(3))
        expected = []
        for i in range(3):
            model = models.fit(rows.filter(F.col("_fold") != i), data, "Logistic Regression", scaled)
            held = models.score(model, rows.filter(F.col("_fold") == i))
            expected.append(held.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0])
        assert found == pytest.approx(expected, abs=1e-4)

    def test_weights_equal_rows(self, grid):
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorAssembler

        data = split.prepare(grid, "name", "classification", ["x1", "x2"])
        found = models.fit(data.rows, data, "Logistic Regression").stages[-1]
        plain = LogisticRegression(
            maxIter=1_000, regParam=1 / 600, standardization=False).fit(
            VectorAssembler(inputCols=data.inputs, outputCol="features").transform(data.rows))
        assert found.coefficients.toArray() == pytest.approx(plain.coefficients.toArray(), rel=1e-3)
        assert found.intercept == pytest.approx(plain.intercept, rel=1e-3)


def test_keys_of_copies_share_the_text_of_their_values(spark):
    rows = [(1.5, "a")] * 3 + [(None, "b")] * 2 + [(None, None)] * 2 + [(2.0, "")]
    df = spark.createDataFrame(rows, "x double, s string")
    groups = df.groupBy("x", "s").agg(F.count("*").alias("_copies"))
    keyed = split._written_out(groups, ["x", "s"])
    # Made before the copies are, once for all of them.
    assert "_text" in plan_text(keyed).split("Generate")[-1]
    want = []
    for (x, s), n in Counter(rows).items():
        for i in range(1, n + 1):
            text = "|".join(str(v) for v in (x, s, i) if v is not None)
            want.append((x, s, int(hashlib.md5(text.encode()).hexdigest()[:15], 16)))
    assert Counter(map(tuple, keyed.collect())) == Counter(want)
