import json

import pytest
from pyspark.sql import functions as F

from vistrata import Profile, job
from vistrata.operators import chartdata, evaluate
from vistrata.sources import files, report


@pytest.fixture
def csv_path(tmp_path, sample_pdf):
    path = tmp_path / "people.csv"
    sample_pdf.to_csv(path, index=False)
    return str(path)


class TestLoad:
    def test_csv_types(self, spark, csv_path, sample_pdf):
        df = files.load(spark, csv_path)
        assert dict(df.dtypes) == {"age": "double", "salary": "double", "score": "double",
                                   "category": "string", "flag": "boolean", "city": "string"}
        assert df.count() == len(sample_pdf)
        assert df.filter("age is null").count() == sample_pdf["age"].isna().sum()

    def test_missing_tokens_keep_numbers(self, spark, tmp_path):
        path = tmp_path / "x.data"
        path.write_text("a,b,c\n1,NA,x\nnull,2.5,\n3,nan,1d\n")
        df = files.load(spark, str(path))
        assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string"}
        assert [tuple(r) for r in df.collect()] == [(1, None, "x"), (None, 2.5, None), (3, None, "1d")]

    def test_schema_spares_inference(self, spark, csv_path):
        df = files.load(spark, csv_path, "age double, city string")
        assert df.columns == ["age", "city"]

    def test_parquet_and_json(self, spark, sample, tmp_path):
        for kind in ("parquet", "json"):
            path = str(tmp_path / f"t.{kind}")
            sample.write.format(kind).save(path)
            assert files.load(spark, path).count() == 103

    def test_spreadsheets_are_refused(self, spark):
        with pytest.raises(ValueError):
            files.load(spark, "book.xlsx")


class TestReport:
    def test_document(self, sample, tmp_path):
        path = tmp_path / "deep" / "er" / "report.json"
        Profile(sample).to_report(str(path))
        document = json.loads(path.read_text())
        assert set(document) == {"overview", "summary", "correlation", "quality"}
        assert document["overview"]["table"]["n_rows"] == 103
        assert document["correlation"]["age"]["age"] == 1.0

    def test_job(self, spark, csv_path, tmp_path, capsys):
        assert job.main(["info", csv_path]) == 0
        assert "n_rows" in capsys.readouterr().out
        out = tmp_path / "a.json"
        assert job.main(["analyze", csv_path, "-o", str(out)]) == 0
        assert set(json.loads(out.read_text())) == {"overview", "summary", "correlation"}
        assert job.main(["report", csv_path, "-o", str(tmp_path / "tidy"), "--tidy"]) == 0
        assert spark.read.json(str(tmp_path / "tidy")).count() > 50
        assert job.main(["info", str(tmp_path / "nothing.csv")]) == 1

    def test_info_lists_every_column(self, sample):
        items = [r.item for r in report.dataset_info(sample).collect()]
        assert sum(i.startswith("missing_count:") for i in items) == len(sample.columns)


class TestFacade:
    def test_steps_chain(self, spark, csv_path):
        cleaned = (
            Profile.from_csv(spark, csv_path).impute(strategy="median").treat_outliers("salary")
            .transform("score", "log1p").encode("city", "label")
            .interaction("age", "score", "add").polynomial(["age"])
        )
        assert {"score_log1p", "city_encoded", "age_add_score", "age^2"} <= set(cleaned.df.columns)
        assert cleaned.df.count() == 103

    def test_statistics(self, sample):
        p = Profile(sample)
        assert p.overview().count() == 1 and set(p.summary_stats()) == {"numeric", "categorical"}
        assert p.correlation().count() == 9 and p.outliers("salary").count() == 1
        assert set(p.multivariate_summary()) == {"vif", "scree"}
        assert p.chart("missing_bar").count() == 2


class TestCharts:
    def test_box_stats(self, sample, sample_pdf):
        row = chartdata.box_stats(sample, "salary").first()
        s = sample_pdf["salary"]
        q1, q3 = s.quantile(0.25), s.quantile(0.75)
        inside = s[(s >= q1 - 1.5 * (q3 - q1)) & (s <= q3 + 1.5 * (q3 - q1))]
        assert (row.whisker_low, row.whisker_high) == pytest.approx(
            (inside.min(), inside.max()), abs=1e-4)
        assert row.n == row.outliers + len(inside)

    def test_scatter(self, sample):
        points = chartdata.scatter_points(sample, "salary", "score", "city")
        assert points.columns == ["salary", "score", "city"] and points.count() == 103
        bins = chartdata.scatter_bins(sample, "salary", "score", 5).collect()
        assert sum(r.n for r in bins) == 103 and all(0 <= r.x_bin < 5 for r in bins)

    def test_raw_series_is_sorted(self, sample):
        xs = [r.x for r in chartdata.time_series(sample, "score", "salary", None).collect()]
        assert xs == sorted(xs)

    def test_importance_bars(self, spark):
        df = spark.createDataFrame([(f"f{i}", float(i)) for i in range(30)],
                                   "feature string, importance double")
        values = [r.importance for r in chartdata.importance_bars(df).collect()]
        assert values == [float(i) for i in range(10, 30)]


class TestEvaluate:
    def test_perfect_and_one_class(self, spark):
        df = spark.createDataFrame([(1, 1), (1, 1)], "y int, p int")
        row = evaluate.eval_classification(df, "y", "p").first()
        assert (row.accuracy, row.f1_weighted) == (1.0, 1.0)
        with pytest.raises(ValueError):
            evaluate.roc_auc(df, "y", "p")

    def test_zero_division(self, spark):
        df = spark.createDataFrame([("a", "b"), ("a", "b")], "y string, p string")
        row = evaluate.eval_classification(df, "y", "p").first()
        assert (row.precision_weighted, row.recall_weighted, row.f1_weighted) == (0.0, 0.0, 0.0)
        cells = {(r.actual, r.predicted): r.n for r in
                 evaluate.confusion_matrix(df, "y", "p", ["a", "b"]).collect()}
        assert cells == {("a", "a"): 0, ("a", "b"): 2, ("b", "a"): 0, ("b", "b"): 0}

    def test_regression_edges(self, spark):
        df = spark.createDataFrame([(0.0, 1.0), (0.0, 0.0)], "y double, p double")
        row = evaluate.eval_regression(df, "y", "p").first()
        assert (row.r2, row.mape, row.mae) == (0.0, 50.0, 0.5)

    def test_empty(self, spark):
        df = spark.createDataFrame([], "y double, p double")
        assert evaluate.eval_regression(df, "y", "p").first().n == 0
        assert evaluate.eval_classification(df, "y", "p").first().n == 0
        assert evaluate.residuals(df.withColumn("k", F.lit(1)), "y", "p", ["k"]).count() == 0
