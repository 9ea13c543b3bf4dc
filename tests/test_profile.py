import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vistrata.operators import profile


def table(df, key="column"):
    return {r[key]: r.asDict() for r in df.collect()}


class TestOverview:
    def test_counts(self, sample, sample_pdf):
        row = profile.overview(sample).first()
        assert (row.n_rows, row.n_columns) == sample_pdf.shape
        assert row.missing_cells == int(sample_pdf.isnull().sum().sum())
        assert row.duplicate_rows == int(sample_pdf.duplicated().sum()) >= 3

    def test_missing_by_column(self, sample, sample_pdf):
        found = table(profile.missing_by_column(sample))
        for name, n in sample_pdf.isnull().sum().items():
            assert found[name]["missing_count"] == n
            assert found[name]["missing_pct"] == round(n / len(sample_pdf) * 100, 2)
        assert found["flag"]["dtype"] == "boolean"

    def test_empty_table(self, tiny):
        row = profile.overview(tiny("empty")).first()
        assert (row.n_rows, row.duplicate_rows, row.missing_cells) == (0, 0, 0)
        assert table(profile.missing_by_column(tiny("empty")))["x"]["missing_pct"] == 0.0

    def test_nan_counts_as_missing(self, tiny):
        assert table(profile.missing_by_column(tiny("nan")))["x"]["missing_count"] == 2

    @pytest.mark.parametrize("hashes", [0, 1, 100_000])
    def test_duplicates_with_and_without_broadcast(self, skewed, skewed_pdf, hashes):
        want = int(skewed_pdf.duplicated().sum())
        assert profile.duplicate_count(skewed, repeated_hashes=hashes) == want

    def test_zero_signs_are_equal(self, spark):
        df = spark.createDataFrame([(0.0,), (-0.0,)], "x double")
        assert profile.duplicate_count(df) == 1

    def test_totals_and_alert(self, tiny):
        row = profile.missing_totals(tiny("missing")).first()
        assert (row.missing_cells, row.missing_pct, row.alert) == (4, 100.0, True)


class TestSummary:
    def test_describe_equals_pandas(self, sample, sample_pdf):
        want = sample_pdf.describe().round(4)
        found = table(profile.describe_numeric(sample))
        assert set(found) == {"age", "salary", "score"}
        for name in found:
            stats = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
            got = [found[name][s] for s in stats]
            assert got == pytest.approx(want[name].tolist(), abs=2e-4)

    def test_describe_edges(self, tiny):
        assert table(profile.describe_numeric(tiny("one")))["x"]["std"] is None
        assert table(profile.describe_numeric(tiny("missing")))["x"]["mean"] is None
        assert table(profile.describe_numeric(tiny("empty")))["x"]["count"] == 0

    def test_top_values(self, sample, sample_pdf):
        rows = profile.top_values(sample).filter("column = 'city'").orderBy("rank").collect()
        counts = sample_pdf["city"].value_counts()
        assert [r.n for r in rows] == sorted(counts.tolist(), reverse=True)[:5]
        assert {r.value: r.n for r in rows} == counts.to_dict()

    def test_skewness_equals_pandas(self, sample, sample_pdf):
        found = table(profile.skewness(sample))
        for name in ("age", "salary", "score"):
            assert found[name]["skewness"] == pytest.approx(sample_pdf[name].skew(), abs=1e-4)

    def test_skewness_edges(self, tiny):
        assert profile.skewness(tiny("one")).count() == 0
        assert table(profile.skewness(tiny("constant")))["x"]["skewness"] == 0.0

    def test_quality(self, sample, sample_pdf):
        found = table(profile.quality_summary(sample))
        assert found["city"]["cardinality"] == sample_pdf["city"].nunique()
        assert found["category"]["cardinality"] == sample_pdf["category"].nunique()
        assert found["age"]["cardinality"] is None and found["age"]["skewness"] is not None
        approx = table(profile.quality_summary(sample, approximate=True))
        assert approx["city"]["cardinality"] == found["city"]["cardinality"]


class TestCorrelation:
    @pytest.mark.parametrize("wide_from", [2, 50])
    def test_equals_pandas(self, sample, sample_pdf, wide_from):
        want = sample_pdf[["age", "salary", "score"]].corr()
        for x, y, r in profile.correlation_matrix(sample, wide_from).collect():
            assert r == pytest.approx(want.loc[x, y], abs=1e-4)

    @pytest.mark.parametrize("wide_from", [2, 50])
    def test_constant_column_has_none(self, spark, wide_from):
        df = spark.createDataFrame([(1.1, 2.0), (1.1, 3.0), (1.1, 5.0)], "a double, b double")
        found = {(x, y): r for x, y, r in profile.correlation_matrix(df, wide_from).collect()}
        assert found["a", "b"] is None and found["a", "a"] is None and found["b", "b"] == 1.0

    def test_one_column(self, spark):
        df = spark.createDataFrame([(1,), (2,), (3,)], "x int")
        assert [tuple(r) for r in profile.correlation_matrix(df).collect()] == [("x", "x", 1.0)]


class TestDistribution:
    @pytest.mark.parametrize("name", ["age", "salary", "score"])
    def test_histogram_equals_numpy(self, sample, sample_pdf, name):
        values = sample_pdf[name].dropna()
        bins = min(30, max(5, len(values) // 10 + 1))
        counts, edges = np.histogram(values, bins=bins)
        rows = profile.histogram(sample, name).orderBy("bin").collect()
        assert [r.n for r in rows] == counts.tolist()
        assert [r.low for r in rows] + [rows[-1].high] == pytest.approx(edges.tolist())

    def test_lattice_values_fall_in_numpy_bins(self, spark):
        values = np.round(np.arange(0, 0.3001, 0.01), 2)
        counts, _ = np.histogram(values, bins=5)
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        rows = profile.histogram(df, "x").orderBy("bin").collect()
        assert [r.n for r in rows] == counts.tolist()

    def test_constant_and_empty(self, tiny):
        rows = profile.histogram(tiny("constant"), "x").orderBy("bin").collect()
        assert (rows[0].low, rows[-1].high, sum(r.n for r in rows)) == (1.5, 2.5, 3)
        empty = profile.histogram(tiny("empty"), "x").collect()
        assert len(empty) == 5 and sum(r.n for r in empty) == 0

    def test_bad_columns(self, sample):
        with pytest.raises(ValueError):
            profile.histogram(sample, "city")
        with pytest.raises(ValueError):
            profile.histogram(sample, "nothing")

    def test_column_distribution_kinds(self, sample):
        assert set(profile.column_distribution(sample, "age")) == {"stats", "bins"}
        assert set(profile.column_distribution(sample, "city")) == {"stats", "value_counts"}
        assert set(profile.column_distribution(sample, "flag")) == {"stats", "bins"}

    def test_outliers(self, sample, sample_pdf):
        s = sample_pdf["salary"]
        q1, q3 = s.quantile(0.25), s.quantile(0.75)
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        row = profile.outliers_iqr(sample, "salary").first()
        assert row.outlier_count == int(((s < low) | (s > high)).sum()) >= 1
        assert (row.lower, row.upper) == pytest.approx((low, high), abs=1e-4)

    def test_outliers_without_values(self, tiny):
        row = profile.outliers_iqr(tiny("missing"), "x").first()
        assert (row.q1, row.outlier_count, row.outlier_pct) == (None, 0, 0.0)

    def test_grid_pages_cover_the_table(self, sample):
        pages = [profile.grid_page(sample, None, [F.desc("salary")], ["score"], p, 50).count()
                 for p in range(3)]
        assert pages == [50, 50, 3]

    def test_missing_patterns_add_up(self, sample, sample_pdf):
        patterns = profile.missing_patterns(sample).collect()
        assert sum(r.row_count for r in patterns) == len(sample_pdf)
        assert isinstance(pd.DataFrame(patterns), pd.DataFrame)


class TestLongTexts:
    """Long texts are counted by compact keys and come back whole."""

    @pytest.fixture
    def texts(self, spark):
        base = "x" * 80
        rows = [(base + "a",)] * 5 + [(base + "b",)] * 3 + [("short",)] * 4 + [(base[:64],)] * 2
        return spark.createDataFrame([*rows, (None,)], "t string")

    def test_top_values(self, texts):
        rows = profile.top_values(texts, ["t"], 3).orderBy("rank").collect()
        assert [(r.value, r.n) for r in rows] == [("x" * 80 + "a", 5), ("short", 4), ("x" * 80 + "b", 3)]

    def test_cardinality(self, texts):
        assert profile.cardinality(texts).first().cardinality == 4
