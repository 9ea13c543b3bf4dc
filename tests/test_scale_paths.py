"""The paths for large data, forced on small skewed data and compared with pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vistrata.operators import association, encode, evaluate, lookup, ordered, quantiles
from vistrata.operators.knn import nearest_neighbours
from vistrata.sources.files import from_pandas

PROBABILITIES = [0.0, 0.01, 0.25, 0.333, 0.5, 0.6, 0.75, 0.999, 1.0]


@pytest.fixture
def many_ranges(monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 200)


class TestQuantiles:
    @pytest.mark.parametrize("buffered,rows", [(10**6, 10), (0, 10), (0, 500), (0, 10**6)])
    def test_narrowing_equals_pandas(self, skewed, skewed_pdf, buffered, rows):
        found = quantiles.exact_quantiles(skewed, ["value", "other"], PROBABILITIES, buffered, rows)
        for name in ("value", "other"):
            want = skewed_pdf[name].quantile(PROBABILITIES).tolist()
            assert found[name] == pytest.approx(want, rel=1e-12, abs=1e-12)

    def test_two_heavy_values(self, spark):
        df = spark.createDataFrame([(13.0,)] * 700 + [(14.0,)] * 500, "x double")
        found = quantiles.exact_quantiles(df, ["x"], [0.3, 0.5, 0.6, 0.9], 0, 1)["x"]
        assert found == [13.0, 13.0, 14.0, 14.0]

    def test_wrong_guess_is_repaired(self, skewed, skewed_pdf):
        values = np.sort(skewed_pdf["value"].dropna())
        asked = {"a": (F.col("value"), 10, 5e8, 6e8), "b": (F.col("value"), 5_000, None, -1e9)}
        found = quantiles.kth_smallest(skewed.na.drop(subset=["value"]), asked)
        assert found == {"a": values[10], "b": values[5_000]}

    def test_missing_column(self, tiny):
        assert quantiles.exact_quantiles(tiny("missing"), ["x"], [0.5], 0) == {"x": [None]}

    # One aggregate, two narrowed groups beside it, and the common order of all groups.
    @pytest.mark.parametrize("buffered,groups", [(10**6, 9), (30, 2), (0, 9)])
    def test_grouped_equals_pandas(self, spark, skewed, skewed_pdf, buffered, groups, many_ranges):
        skewed_pdf = skewed_pdf.copy()
        skewed_pdf.loc[skewed_pdf["grp"].between("g000", "g099"), "grp"] = "crowded"
        skewed = from_pandas(spark, skewed_pdf)
        rows = quantiles.grouped_quantiles(
            skewed, "grp", "value", [0.25, 0.5, 0.75], buffered, groups)
        found = {r["grp"]: [r.q0, r.q1, r.q2] for r in rows.collect()}
        want = skewed_pdf.dropna(subset=["value"]).groupby("grp")["value"]
        assert len(found) == want.ngroups
        for name, values in want:
            assert found[name] == pytest.approx(values.quantile([0.25, 0.5, 0.75]).tolist())


class TestOrdered:
    @pytest.mark.parametrize("descending", [False, True])
    def test_running_totals(self, spark, descending, many_ranges):
        rng = np.random.default_rng(1)
        keys = [f"k{v:05d}" for v in rng.permutation(5_000)]
        pdf = pd.DataFrame({"k": keys, "w": rng.integers(0, 9, 5_000)})
        found = ordered.running_totals(
            from_pandas(spark, pdf), ["k"], ["w"], 5_000, descending).toPandas()
        pdf = pdf.sort_values("k", ascending=not descending)
        want = dict(zip(pdf["k"], pdf["w"].cumsum() - pdf["w"]))
        following = dict(zip(pdf["k"], pdf["w"].shift(-1)))
        assert dict(zip(found["k"], found["before_w"])) == want
        for k, w in zip(found["k"], found["next_w"]):
            assert (np.isnan(w) and np.isnan(following[k])) or w == following[k]

    def test_ranges_are_balanced(self, spark, many_ranges):
        df = spark.range(5_000).withColumn("w", F.lit(1))
        placed, _, _ = ordered._cut_into_ranges(df, ["id"], ["w"], 5_000, False, 200)
        sizes = [r["count"] for r in placed.groupBy("_range").count().collect()]
        assert len(sizes) > 10 and max(sizes) < 1_000


class TestLookup:
    @pytest.mark.parametrize("limit", [None, 0])
    @pytest.mark.parametrize("method", ["label", "ordinal", "frequency"])
    def test_encoders(self, skewed, skewed_pdf, method, limit, many_ranges):
        out, _ = encode.encode_categorical(
            skewed, "grp", method, drop_original=False, broadcast_bytes=limit)
        name = out.columns[-1]
        rows = out.select("grp", name).toPandas()
        assert len(rows) == len(skewed_pdf)
        seen = skewed_pdf["grp"].dropna()
        if method == "frequency":
            want = seen.value_counts(normalize=True).to_dict()
        else:
            want = {v: i for i, v in enumerate(sorted(seen.unique()))}
        for value, code in zip(rows["grp"], rows[name]):
            if value is None:
                assert code == -1 if method == "label" else np.isnan(code)
            else:
                assert code == pytest.approx(want[value])

    def test_hot_values_stay_out_of_the_shuffle(self, skewed, monkeypatch):
        monkeypatch.setattr(lookup, "HOT_VALUES", 5)
        frequencies = skewed.select(F.col("grp").alias("value")).na.drop().groupBy("value").agg(
            F.count("*").alias("n_rows"))
        size = lookup.value_sizes(skewed, ["grp"])["grp"]
        joined = lookup.attach_by_value(
            skewed, "grp", frequencies.withColumn("payload", F.col("n_rows")), size, 0)
        assert joined.count() == skewed.count()
        hot = joined.filter("grp = 'hot'").select("payload").distinct().collect()
        assert len(hot) == 1 and hot[0][0] == skewed.filter("grp = 'hot'").count()


class TestRanks:
    @pytest.mark.parametrize("limit", [None, 0])
    def test_average_ranks(self, skewed, skewed_pdf, limit, many_ranges):
        rows = skewed.na.drop().select("value", "other").withColumn("v", F.col("value"))
        ranked = association.average_ranks(rows, ["value", "other"], limit).toPandas()
        pdf = skewed_pdf.dropna()
        want = dict(zip(pdf["value"], pdf["value"].rank()))
        assert all(r == want[v] for v, r in zip(ranked["v"], ranked["value"]))
        assert ranked["value"].corr(ranked["other"]) == pytest.approx(
            pdf["value"].rank().corr(pdf["other"].rank()))

    def test_auc_over_ranges(self, skewed, skewed_pdf, many_ranges):
        rows = skewed.na.drop().withColumn("y", F.col("other") > 3)
        pdf = skewed_pdf.dropna()
        y, s = (pdf["other"] > 3).to_numpy(), pdf["value"].to_numpy()
        ranks = pdf["value"].rank().to_numpy()
        want = (ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
        assert evaluate.roc_auc(rows, "y", "value").first()[0] == pytest.approx(want, abs=1e-4)
        whole = evaluate.roc_points(rows, "y", "value", drop_collinear=False).toPandas()
        kept = evaluate.roc_points(rows, "y", "value").toPandas()
        assert len(whole) == len(np.unique(s)) + 1
        for points in (whole, kept):
            points = points.sort_values(["fpr", "tpr"])
            area = np.trapezoid(points["tpr"], points["fpr"])
            assert area == pytest.approx(want, abs=1e-9)
        assert len(kept) < len(whole)


class TestNeighbours:
    @pytest.mark.parametrize("pivots,block", [(1, 4_000), (12, 4_000), (12, 40)])
    def test_equals_brute_force(self, spark, pivots, block):
        rng = np.random.default_rng(5)
        centres = rng.normal(0, 10, (6, 4))
        x = centres[rng.integers(0, 6, 900)] + rng.normal(0, 1, (900, 4))
        x[rng.uniform(size=900) < 1 / 3] = x[0]
        q = np.vstack([x[:50], rng.normal(0, 12, (70, 4))])
        train = spark.createDataFrame(
            [(i, v.tolist(), float(i % 3)) for i, v in enumerate(x)],
            "id long, vec array<double>, label double")
        queries = spark.createDataFrame(
            [(i, v.tolist()) for i, v in enumerate(q)], "qid long, vec array<double>")
        found = nearest_neighbours(train, queries, 5, pivots, block).toPandas()
        assert len(found) == len(q) * 5
        d = np.round(np.sqrt(((q[:, None, :] - x[None, :, :]) ** 2).sum(2)), 9)
        for i, part in found.groupby("qid"):
            want = np.lexsort((np.arange(len(x)), d[i]))[:5]
            assert part.sort_values("rank")["id"].tolist() == want.tolist()

    def test_fewer_rows_than_neighbours(self, spark):
        train = spark.createDataFrame([(1, [0.0], 1.0)], "id long, vec array<double>, label double")
        queries = spark.createDataFrame([(1, [3.0])], "qid long, vec array<double>")
        rows = nearest_neighbours(train, queries, 5).collect()
        assert [(r.id, r.distance) for r in rows] == [(1, 3.0)]
