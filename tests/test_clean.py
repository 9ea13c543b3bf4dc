import numpy as np
import pytest
from pyspark.sql import functions as F

from vistrata.operators import clean, encode, features, profile, transform


def column(df, name):
    return [r[0] for r in df.select(name).collect()]


class TestImpute:
    @pytest.mark.parametrize("strategy", ["mean", "median"])
    def test_numeric(self, sample, sample_pdf, strategy):
        out, summary = clean.impute_missing(sample, strategy=strategy)
        want = getattr(sample_pdf["age"], strategy)()
        assert sorted(column(out, "age")) == pytest.approx(
            sorted(sample_pdf["age"].fillna(want).tolist()))
        rows = {r["column"]: r for r in summary.collect()}
        assert rows["age"].missing_after == 0
        assert rows["category"].missing_before == rows["category"].missing_after > 0

    def test_mode_prefers_the_smallest_of_ties(self, spark):
        df = spark.createDataFrame([(2, "b"), (10, "a"), (None, None)], "n int, s string")
        out, _ = clean.impute_missing(df, strategy="mode")
        assert sorted(column(out, "n")) == [2, 2, 10] and sorted(column(out, "s")) == ["a", "a", "b"]

    def test_mode_of_nothing(self, tiny):
        out, summary = clean.impute_missing(tiny("missing"), strategy="mode")
        assert column(out, "x") == [None, None]
        assert {r.missing_after for r in summary.collect()} == {2}

    def test_constant_and_bad_value(self, sample):
        out, _ = clean.impute_missing(sample, ["category"], "constant", "none")
        assert "none" in column(out, "category")
        with pytest.raises(Exception):
            clean.impute_missing(sample, ["age"], "constant", "none")[0].collect()

    def test_drop(self, sample, sample_pdf):
        out, summary = clean.impute_missing(sample, ["age"], "drop")
        assert out.count() == sample_pdf["age"].notna().sum()
        assert summary.first().rows_dropped == sample_pdf["age"].isna().sum()

    def test_nan_is_filled(self, tiny):
        out, _ = clean.impute_missing(tiny("nan"), ["x"], "mean")
        assert sorted(column(out, "x")) == [1.0, 2.5, 2.5, 4.0]

    def test_invalid(self, sample):
        with pytest.raises(ValueError):
            clean.impute_missing(sample, strategy="magic")
        with pytest.raises(ValueError):
            clean.impute_missing(sample, ["nothing"])

    def test_no_missing_values(self, tiny):
        out, summary = clean.impute_missing(tiny("constant"))
        assert out.count() == 3 and summary.count() == 0


class TestOutliers:
    @pytest.mark.parametrize("method", ["iqr", "zscore"])
    def test_cap(self, sample, method):
        out, summary = clean.treat_outliers(sample, "salary", method, "cap")
        assert max(column(out, "salary")) < 1_000_000 and summary.first().outliers_found >= 1

    def test_missing_values_survive(self, spark):
        rows = [(float(i),) for i in range(20)] + [(1e6,), (None,)]
        df = spark.createDataFrame(rows, "x double")
        capped = column(clean.treat_outliers(df, "x")[0], "x")
        assert capped.count(None) == 1 and len(capped) == 22
        removed, summary = clean.treat_outliers(df, "x", action="remove")
        assert column(removed, "x").count(None) == 1 and removed.count() == 21
        assert summary.first().rows_after == 21
        assert sum(column(clean.treat_outliers(df, "x", action="flag")[0], "x_outlier")) == 1

    def test_invalid(self, sample):
        for how in ({"method": "x"}, {"action": "x"}):
            with pytest.raises(ValueError):
                clean.treat_outliers(sample, "salary", **how)
        with pytest.raises(ValueError):
            clean.treat_outliers(sample, "city")


class TestTransform:
    def test_standardize_and_normalize(self, sample):
        z = np.array(column(transform.transform_column(sample, "score", "standardize")[0],
                            "score_standardize"))
        assert z.mean() == pytest.approx(0, abs=1e-9) and z.std(ddof=1) == pytest.approx(1)
        u = column(transform.transform_column(sample, "score", "normalize", "u")[0], "u")
        assert (min(u), max(u)) == (0.0, 1.0)

    def test_constant(self, tiny):
        for name in ("standardize", "normalize"):
            out, summary = transform.transform_column(tiny("constant"), "x", name, "y")
            assert column(out, "y") == [0.0] * 3 and summary.first().skew_after == 0.0

    def test_log1p_edges(self, spark):
        df = spark.createDataFrame([(-2.0,), (-1.0,), (0.0,), (None,)], "x double")
        out = column(transform.transform_column(df, "x", "log1p", "y")[0], "y")
        assert out == [None, float("-inf"), 0.0, None]

    def test_sqrt_clips(self, spark):
        df = spark.createDataFrame([(-4.0,), (4.0,), (None,)], "x double")
        assert column(transform.transform_column(df, "x", "sqrt", "y")[0], "y") == [0.0, 2.0, None]

    @pytest.mark.parametrize("method", ["boxcox", "yeojohnson"])
    def test_fitted_power_is_a_maximum(self, spark, method):
        rng = np.random.default_rng(9)
        x = np.exp(rng.normal(1, 0.6, 3_000))
        df = spark.createDataFrame([(float(v),) for v in x], "x double")
        power = transform.fit_power(df, "x", method)
        at = transform.log_likelihoods(df, "x", method, [power - 1e-3, power, power + 1e-3])
        assert at[1] >= max(at[0], at[2])
        out, summary = transform.transform_column(df, "x", method)
        row = summary.first()
        assert abs(row.skew_after) < 0.2 < row.skew_before
        if method == "boxcox":
            assert abs(power) < 0.1

    def test_power_outside_the_first_range(self, spark):
        rng = np.random.default_rng(2)
        x = rng.normal(100, 5, 2_000) ** (1 / 6)
        df = spark.createDataFrame([(float(v),) for v in x], "x double")
        assert 2 < transform.fit_power(df, "x", "boxcox") < 20

    def test_boxcox_skips_non_positive(self, spark):
        df = spark.createDataFrame([(-1.0,), (0.0,), (1.0,), (2.0,), (5.0,)], "x double")
        out = column(transform.transform_column(df, "x", "boxcox", "y")[0], "y")
        assert out[:2] == [None, None] and None not in out[2:]

    def test_invalid(self, sample, tiny):
        with pytest.raises(ValueError):
            transform.transform_column(sample, "score", "cube")
        with pytest.raises(ValueError):
            transform.transform_column(tiny("constant"), "x", "boxcox")


class TestEncode:
    def test_label(self, sample, sample_pdf):
        out, summary = encode.encode_categorical(sample, "category")
        assert "category" not in out.columns
        want = sample_pdf["category"].astype("category").cat.codes
        assert sorted(column(out, "category_encoded")) == sorted(want.tolist())
        assert summary.first().unique_values == 4

    def test_onehot(self, sample, sample_pdf):
        out, summary = encode.encode_categorical(sample, "category", "onehot")
        names = [f"category_{c}" for c in "ABCD"]
        assert summary.first().new_columns == names and "category" not in out.columns
        total = out.select(sum(F.col(n) for n in names).alias("t"))
        assert sum(r.t for r in total.collect()) == sample_pdf["category"].notna().sum()

    def test_onehot_of_listed_categories(self, sample):
        out, summary = encode.encode_categorical(sample, "category", "onehot", categories=["B", "?"])
        assert summary.first().new_columns == ["category_B", "category_?"]
        assert out.agg(F.max("category_?")).first()[0] == 0

    def test_sparse_onehot_of_any_width(self, spark):
        df = spark.range(4_000).selectExpr(
            "id", "CASE WHEN id % 5 > 0 THEN concat('v', lpad(id, 5, '0')) END AS c")
        out, _ = encode.encode_categorical(df, "c", "onehot_sparse", broadcast_bytes=0)
        rows = {r.id: r.c_onehot for r in out.collect()}
        assert len(rows) == 4_000 and {v.size for v in rows.values()} == {3_200}
        assert not len(rows[0].indices) and list(rows[1].indices) == [0]
        assert list(rows[3_999].indices) == [3_199]

    def test_sparse_onehot_without_values(self, spark):
        df = spark.createDataFrame([(None,), (None,)], "c string")
        out, _ = encode.encode_categorical(df, "c", "onehot_sparse")
        assert [len(r[0].indices) for r in out.collect()] == [0, 0]

    def test_mode_of_long_texts_is_the_smallest_of_the_ties(self, spark):
        texts = ["x" * 80 + c for c in "dbca"] * 2 + [None]
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        assert clean.modes(df, ["t"])["t"] == "x" * 80 + "a"
        top = profile.top_values(df, ["t"], 3).orderBy("rank").collect()
        assert [r.value[-1] for r in top] == ["a", "b", "c"]

    def test_names_with_dots_and_quotes(self, spark):
        df = spark.createDataFrame([("it's a.b`c",), (None,)], "`k.v` string")
        out, _ = encode.encode_categorical(df, "k.v", "onehot")
        assert out.columns == ["k.v_it's a.b`c"]
        assert [r[0] for r in out.collect()] == [1, 0]

    def test_ordinal_order(self, sample):
        out, _ = encode.encode_categorical(sample, "category", "ordinal", ["D", "C"])
        assert set(column(out, "category_ordinal")) == {0, 1, None}

    def test_frequency_in_unit_range(self, sample):
        out, _ = encode.encode_categorical(sample, "city", "frequency", drop_original=False)
        assert all(0 < v <= 1 for v in column(out, "city_freq")) and "city" in out.columns

    def test_boolean(self, sample):
        out, _ = encode.encode_categorical(sample, "flag")
        assert set(column(out, "flag_encoded")) == {0, 1}

    def test_invalid(self, sample):
        with pytest.raises(ValueError):
            encode.encode_categorical(sample, "city", "hash")


@pytest.fixture(scope="module")
def linear(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (150, 3))
    y = 2 * x[:, 0] - 3 * x[:, 1] + rng.normal(0, 0.5, 150)
    rows = [(*map(float, r), float(t), "p" if t > 0 else "n") for r, t in zip(x, y)]
    return spark.createDataFrame(
        rows, "x1 double, x2 double, x3 double, target double, cls string").cache()


class TestFeatures:
    def test_scores(self, linear):
        rows = {r.feature: r for r in features.feature_target_stats(linear, "target").collect()}
        assert abs(rows["x2"].pearson) > abs(rows["x1"].pearson) > abs(rows["x3"].pearson)
        assert rows["x2"].mutual_info > rows["x3"].mutual_info

    def test_select_k_best(self, linear):
        for target, kind in (("target", "regression"), ("cls", "classification")):
            rows = features.select_k_best(linear.drop("target" if kind != "regression" else "cls"),
                                          target, 2, kind).collect()
            assert [r.feature for r in rows if r.selected] == ["x1", "x2"]
            assert all(0 <= r.p_value <= 1 for r in rows)

    def test_unknown_target(self, linear):
        for run in (features.feature_pearson, features.feature_spearman, features.select_k_best):
            assert run(linear, "nothing").count() == 0

    def test_few_rows(self, linear):
        assert features.feature_pearson(linear.limit(4), "target").count() == 0

    def test_variance(self, spark):
        df = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "a int, b int")
        rows = {r["column"]: r.selected for r in features.select_by_variance(df).collect()}
        assert rows == {"a": False, "b": True}
        with pytest.raises(ValueError):
            features.select_by_variance(df, 100.0)
        assert features.select_by_variance(df, exclude=["a"]).count() == 1

    def test_polynomial_names_and_values(self, linear):
        out, names = features.create_polynomial_features(linear, ["x1", "x2", "x3"], 3)
        assert names == ["x1^2", "x1^3", "x2^2", "x2^3", "x3^2", "x3^3", "x1*x2", "x1*x3", "x2*x3"]
        row = out.first()
        assert row["x1*x2"] == pytest.approx(row.x1 * row.x2)
        assert features.create_polynomial_features(linear, ["x1"], 2)[1] == ["x1^2"]

    def test_interaction(self, spark):
        df = spark.createDataFrame([(6.0, 3.0), (1.0, 0.0)], "a double, b double")
        out, name = features.create_interaction_feature(df, "a", "b", "divide")
        assert name == "a_divide_b" and column(out, f"`{name}`") == [2.0, None]
        with pytest.raises(ValueError):
            features.create_interaction_feature(df, "a", "b", "power")


class TestPowerFarFromOne:
    """Columns on which the plain formula cancels or overflows, against a search in numpy."""

    @pytest.mark.parametrize("method", ["boxcox", "yeojohnson"])
    @pytest.mark.parametrize("kind", ["years", "narrow"])
    def test_fit(self, spark, method, kind):
        rng = np.random.default_rng(1)
        x = rng.integers(1990, 2025, 800).astype(float) if kind == "years" else (
            1000 + rng.random(800))
        df = spark.createDataFrame([(float(v),) for v in x], "x double")
        power = transform.fit_power(df, "x", method)
        logs = np.log(x) if method == "boxcox" else np.log1p(x)
        logs -= logs.mean()

        def fit(p):
            return -len(x) / 2 * np.log(np.var(np.expm1(p * logs) / p))

        reach = max(0.1, abs(power) / 10)
        best = max(fit(p) for p in power + np.linspace(-reach, reach, 2_000))
        assert fit(power) >= best - 1e-6

    def test_two_sided(self, spark):
        x = np.random.default_rng(4).normal(0.5, 2, 800)
        df = spark.createDataFrame([(float(v),) for v in x], "x double")

        def fit(p):
            y = np.where(x >= 0, (np.abs(x) + 1) ** p - 1, 0) / p - np.where(
                x < 0, (1 + np.abs(x)) ** (2 - p) - 1, 0) / (2 - p)
            return (p - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum() - len(x) / 2 * np.log(
                np.var(y))

        grid = np.linspace(0.5, 1.5, 2_000)
        best = grid[int(np.argmax([fit(p) for p in grid]))]
        assert abs(transform.fit_power(df, "x", "yeojohnson") - best) < 1e-3
