import math

import numpy as np
import pytest

import __spark_entry__ as entry
from vistrata.functions import pvalues
from vistrata.operators import association
from vistrata.sources.files import from_pandas


class TestTailProbabilities:
    # Published critical values (statistical tables).
    @pytest.mark.parametrize("t,df,p", [(2.228, 10, 0.05), (2.086, 20, 0.05), (3.169, 10, 0.01),
                                        (1.96, 10**7, 0.05)])
    def test_t(self, t, df, p):
        assert pvalues.t_two_sided(t, df) == pytest.approx(p, abs=1e-4)

    @pytest.mark.parametrize("f,d1,d2,p", [(4.965, 1, 10, 0.05), (3.098, 3, 20, 0.05),
                                           (5.849, 2, 20, 0.01)])
    def test_f(self, f, d1, d2, p):
        assert pvalues.f_upper(f, d1, d2) == pytest.approx(p, abs=1e-4)

    @pytest.mark.parametrize("x,dof,p", [(3.841, 1, 0.05), (18.307, 10, 0.05), (6.635, 1, 0.01),
                                         (124.342, 100, 0.05)])
    def test_chi2(self, x, dof, p):
        assert pvalues.chi2_upper(x, dof) == pytest.approx(p, abs=1e-4)

    def test_closed_forms(self):
        assert pvalues.f_upper(2.5, 2, 30) == pytest.approx((1 + 5 / 30) ** -15, rel=1e-12)
        assert pvalues.chi2_upper(7.0, 2) == pytest.approx(math.exp(-3.5), rel=1e-12)
        assert pvalues.chi2_upper(7.0, 1) == pytest.approx(math.erfc(math.sqrt(3.5)), rel=1e-10)
        assert pvalues.chi2_upper(0.0, 0) == 1.0 and pvalues.correlation_p(1.0, 9) == 0.0
        assert pvalues.f_upper(2.5, 2, 54_000) == pytest.approx(
            (1 + 5 / 54_000) ** -27_000, rel=1e-9)


class TestPairs:
    def test_pearson(self, sample, sample_pdf):
        row = association.pearson_pair(sample, "age", "score").first()
        pdf = sample_pdf[["age", "score"]].dropna()
        assert row.n == len(pdf) and row.pearson_r == pytest.approx(
            pdf["age"].corr(pdf["score"]), abs=1e-4)
        assert 0 <= row.pearson_p <= 1

    def test_spearman(self, sample, sample_pdf):
        row = association.spearman_pair(sample, "age", "salary").first()
        pdf = sample_pdf[["age", "salary"]].dropna()
        assert row.spearman_r == pytest.approx(pdf["age"].rank().corr(pdf["salary"].rank()), abs=1e-4)

    def test_constant_has_no_correlation(self, spark):
        df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "a double, b double")
        assert association.pearson_pair(df, "a", "b").first().pearson_r is None

    def test_groups(self, sample, sample_pdf):
        want = sample_pdf.dropna(subset=["category"]).groupby("category")["salary"]
        for row in association.group_stats(sample, "salary", "category").collect():
            values = want.get_group(row.category)
            assert row.n == len(values)
            assert (row.mean, row.median, row.std) == pytest.approx(
                (values.mean(), values.median(), values.std()), abs=1e-4)

    def test_one_group_has_no_f(self, tiny):
        row = association.anova(tiny("constant"), "x", "c").first()
        assert (row.groups, row.anova_f, row.anova_p) == (1, None, None)

    def test_crosstab_over_listed_values_has_zero_cells(self, spark):
        df = spark.createDataFrame([("a", "u"), ("b", "v"), ("b", None)], "x string, y string")
        cells = {(r.x, r.y): r.n for r in association.crosstab(df, "x", "y", ["u", "v"]).collect()}
        assert cells == {("a", "u"): 1, ("a", "v"): 0, ("b", "u"): 0, ("b", "v"): 1}
        assert association.crosstab(df, "x", "y").count() == 2

    def test_crosstab_of_many_values_is_complete(self, spark):
        df = spark.range(3_000).selectExpr("id % 2 AS x", "id % 1001 AS y")
        assert association.crosstab(df, "x", "y", list(range(1_001))).count() == 2_002
        assert association.crosstab(df, "x", "y").count() == df.distinct().count()

    def test_crosstab_joins_the_values_of_a_table(self, spark):
        df = spark.range(9_000).selectExpr("id % 3 AS x", "id % 7 * 2 + 5000 AS y").union(
            spark.sql("SELECT 1L, NULL"))
        values = spark.range(20_000).selectExpr("id AS k").union(
            spark.sql("SELECT 7L UNION ALL SELECT NULL"))
        got = association.crosstab(df, "x", "y", values).cache()
        assert got.count() == 3 * 20_000 == got.distinct().count()
        seen = {(r.x, r.y): r.n for r in got.filter("n > 0").collect()}
        assert seen == {(r.x, r.y): r.n for r in association.crosstab(df, "x", "y").collect()}

    def test_crosstab_all_parts_counts_every_row(self, spark):
        rows = entry.queries()["crosstab_all_parts"](spark, "/root/testdata/sf0.01")
        total = entry.table(spark, "/root/testdata/sf0.01", "lineitem").count()
        assert rows.agg({"n": "sum"}).first()[0] == total

    def test_chi_square_counts_unseen_cells(self, spark):
        rows = [("a", "u")] * 10 + [("b", "v")] * 20 + [("c", "w")] * 5 + [("a", "v")] * 3
        df = spark.createDataFrame(rows, "x string, y string")
        table = {("a", "u"): 10, ("b", "v"): 20, ("c", "w"): 5, ("a", "v"): 3}
        nx, ny, n = {"a": 13, "b": 20, "c": 5}, {"u": 10, "v": 23, "w": 5}, 38
        want = sum((table.get((x, y), 0) - nx[x] * ny[y] / n) ** 2 / (nx[x] * ny[y] / n)
                   for x in nx for y in ny)
        row = association.chi_square(df, "x", "y").first()
        assert (row.dof, row.n) == (4, n) and row.chi2 == pytest.approx(want, abs=1e-4)

    def test_one_category(self, tiny):
        row = association.chi_square(tiny("constant"), "c", "c").first()
        assert (row.chi2, row.chi2_p, row.dof) == (0.0, 1.0, 0)

    def test_dispatch(self, sample):
        kinds = {("age", "flag"): "numeric_numeric", ("age", "city"): "numeric_categorical",
                 ("city", "category"): "categorical_categorical"}
        for (x, y), kind in kinds.items():
            assert association.bivariate(sample, x, y)["type"] == kind


class TestManyColumns:
    def test_scree(self, sample):
        rows = association.eigen_scree(sample).orderBy("pc").collect()
        values = [r.eigenvalue for r in rows]
        assert sum(values) == pytest.approx(3, abs=1e-3) and values == sorted(values, reverse=True)
        assert rows[-1].cumulative_pct == pytest.approx(100, abs=0.05)

    def test_constant_column_is_left_out(self, spark):
        df = spark.createDataFrame([(1.0, 2.0, 1.0), (1.0, 3.0, 5.0), (1.0, 5.0, 2.0)],
                                   "a double, b double, c double")
        assert association.eigen_scree(df).count() == 2
        found = {r["column"]: r.vif for r in association.vif_approx(df).collect()}
        assert found["a"] == 1.0 and found["b"] == found["c"] > 1.0

    def test_perfect_collinearity(self, spark):
        df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (4.0, 8.0)], "a double, b double")
        assert {r.vif for r in association.vif_approx(df).collect()} == {float("inf")}
        assert all(r.multicollinear for r in association.vif_flags(df).collect())

    def test_too_few_columns(self, spark):
        df = from_pandas(spark, spark.range(3).toPandas())
        assert association.vif_approx(df).count() == association.eigen_scree(df).count() == 0


def correlation_p_by_integration(r, n):
    """Two-sided p: with t = sqrt(n - 2) tan(a) the t density is cos(a) ** (n - 3)."""
    low, width = math.asin(abs(r)), 40 / math.sqrt(n)

    def area(a):
        grid = np.linspace(a, min(math.pi / 2, a + width), 400_001)
        return np.trapezoid(np.cos(grid) ** (n - 3), grid)
    return area(low) / area(0.0)


class TestRegisteredP:
    """The p columns of the registered queries against numerical integration."""

    SF_DIR = "/root/testdata/sf0.001"

    @pytest.fixture(scope="class")
    def messy(self, spark):
        columns = [*entry.MEASURES, "is_bulk", "status"]
        return entry.messy(spark, self.SF_DIR).select(*columns).toPandas()

    def row(self, spark, name):
        return entry.queries()[name](spark, self.SF_DIR).first()

    def test_correlations(self, spark, messy):
        pairs = messy[["price", "quantity"]].astype(float).dropna()
        for kind, values in (("pearson", pairs), ("spearman", pairs.rank())):
            got = self.row(spark, f"{kind}_pair_p")
            r = np.corrcoef(values.T)[0, 1]
            assert got.n == len(pairs) and got[f"{kind}_r"] == pytest.approx(r, abs=6e-5)
            want = correlation_p_by_integration(r, len(pairs))
            assert got[f"{kind}_p"] == pytest.approx(want, abs=2e-6)

    def test_chi_square(self, spark, messy):
        table = messy.groupby(["is_bulk", "status"]).size().unstack().to_numpy(float)
        expected = np.outer(table.sum(1), table.sum(0)) / table.sum()
        gap = np.abs(table - expected)
        chi2 = (((gap - np.minimum(0.5, gap)) ** 2) / expected).sum()
        root = math.sqrt(chi2)  # chi-square of one degree is the square of a normal value
        grid = np.linspace(root, root + 40, 400_001)
        want = 2 * np.trapezoid(np.exp(-grid ** 2 / 2), grid) / math.sqrt(2 * math.pi)
        got = self.row(spark, "chi2_yates_p")
        assert got.chi2 == pytest.approx(chi2, abs=6e-5)
        assert got.chi2_p == pytest.approx(want, abs=2e-6)

    def test_regression_scores(self, spark, messy):
        rows = messy[entry.MEASURES].astype(float).dropna()
        got = entry.queries()["select_k_best_regression_p"](spark, self.SF_DIR).collect()
        assert [r.feature for r in got] == ["quantity", "discount", "tax"]
        for r in got:
            corr = np.corrcoef(rows[r.feature], rows["price"])[0, 1]
            want = correlation_p_by_integration(corr, len(rows))
            assert r.p_value == pytest.approx(want, abs=2e-6)
