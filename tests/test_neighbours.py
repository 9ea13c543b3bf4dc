"""Pruned neighbour search, mutual information by neighbours and support vector regression."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vistrata.operators import dual, gram, information, knn, models, split, trees
from vistrata.operators.kernel import random_features
from vistrata.plans.inspect import count_nodes, plan_text


def frame(spark, x, name="id", **more):
    rows = pd.DataFrame({name: np.arange(len(x)), "vec": x.tolist(), **more})
    return spark.createDataFrame(rows)


def brute(x, q, k, metric="euclidean", apart=None):
    gaps = np.abs(q[:, None, :] - x[None, :, :])
    d = gaps.max(axis=2) if metric == "chebyshev" else np.sqrt((gaps * gaps).sum(axis=2))
    d = np.round(d, 9)
    if apart is not None:
        d = np.where(apart, d, np.inf)
    return [np.lexsort((np.arange(len(x)), row))[:k].tolist() for row in d]


def found_ids(found, n):
    got = {q: part.sort_values("rank")["id"].tolist() for q, part in found.groupby("qid")}
    return [got.get(i, []) for i in range(n)]


# ---------------------------------------------------------------- search


def test_chebyshev_distances_take_a_column_at_a_time():
    rng = np.random.default_rng(1)
    x, pivots = rng.normal(size=(1_000, 40)), rng.normal(size=(200, 40))
    tracemalloc.start()
    found = knn._pivot_distances(x, pivots, "chebyshev")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All columns of all pairs are 64 MB.
    assert peak < 16_000_000
    assert (found == np.abs(x[:, None, :] - pivots[None, :, :]).max(axis=2)).all()


def test_cells_are_summed_up_in_a_stream(spark):
    """Cells that go on over batches and tasks, and no call per cell."""
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"cell": rng.integers(0, 40, 1_000), "to_pivot": rng.uniform(size=1_000)})
    x = rng.normal(size=(1_000, 2))
    rows["vec"] = x.tolist()
    pivots = pd.DataFrame({"parent": 0, "cell": np.arange(40), "pivot": [[0.0, 0.0]] * 40})
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        table = knn._summaries(
            spark.createDataFrame(rows).repartition(3), spark.createDataFrame(pivots))
        found = table.toPandas().set_index("cell")
        plan = table._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(size, before)
    assert len(found) == 40 and "FlatMapGroupsInPandas" not in plan
    for cell, part in rows.groupby("cell"):
        own, at = found.loc[cell], x[part.index]
        assert own["n"] == len(part) and own["radius"] == part["to_pivot"].max()
        assert (np.array(own["low"]) == at.min(axis=0)).all()
        assert (np.array(own["high"]) == at.max(axis=0)).all()


@pytest.mark.parametrize("metric", ["euclidean", "chebyshev"])
def test_block_search_with_many_ties_in_pieces(metric, monkeypatch):
    monkeypatch.setattr(knn, "CANDIDATES", 100)
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (120, 2)).astype(float)
    q = np.vstack([x[:40], rng.normal(size=(30, 2))])
    ids = rng.permutation(120)
    train = pd.DataFrame({"key": ids, "vec": list(x), "label": 0.0, "part": 0})
    queries = pd.DataFrame({"key": np.arange(70), "vec": list(q), "part": 1})
    found = knn._search_block(4, metric, 9)(train, queries)
    order = np.argsort(ids)
    got = [found[found["qid"] == i]["id"].tolist() for i in range(70)]
    assert got == brute(x[order], q, 4, metric)



def test_search_divides_crowded_cells_and_skips_far_ones(spark, monkeypatch):
    """Three features: below a quarter of the cells for a query, over more than one level."""
    monkeypatch.setattr(knn, "CELL_ROWS", 60)
    monkeypatch.setattr(knn, "FANOUT", 32)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3_000, 3))
    x[:900] = x[0]
    q = np.vstack([x[::30], rng.normal(size=(100, 3))])
    seen = {}
    down, divide = knn._down_within, knn._divide

    def watched(*args):
        seen["routed"] = down(*args)
        return seen["routed"]

    def cells(*args):
        out = divide(*args)
        seen["cells"], seen["levels"] = out[0].select("cell").distinct().count(), len(out[1])
        return out

    monkeypatch.setattr(knn, "_down_within", watched)
    monkeypatch.setattr(knn, "_divide", cells)
    found = knn.nearest_neighbours(
        frame(spark, x, label=np.zeros(len(x))), frame(spark, q, "qid"), 5).toPandas()
    assert found_ids(found, len(q)) == brute(x, q, 5)
    assert seen["levels"] > 1 and seen["cells"] > 60
    assert seen["routed"].count() < 0.25 * seen["cells"] * len(q)


@pytest.mark.parametrize("metric", ["euclidean", "chebyshev"])
def test_neighbours_of_other_parts(spark, metric, monkeypatch):
    monkeypatch.setattr(knn, "CELL_ROWS", 30)
    rng = np.random.default_rng(1)
    x = rng.integers(0, 12, (600, 2)).astype(float)
    fold = rng.integers(0, 4, 600)
    rows = frame(spark, x, label=np.zeros(600), fold=fold)
    queries = frame(spark, x, "qid", fold=fold)
    found = knn.nearest_neighbours(rows, queries, 3, part="fold", metric=metric).toPandas()
    want = brute(x, x, 3, metric, fold[:, None] != fold[None, :])
    assert found_ids(found, 600) == want


@pytest.mark.parametrize("part", [None, "fold"])
def test_tiles_where_bounds_rule_out_little(spark, monkeypatch, part):
    """Many independent columns: all queries meet large blocks of rows, and no query every cell."""
    monkeypatch.setattr(knn, "CELL_ROWS", 40)
    monkeypatch.setattr(knn, "PROBED_ROWS", 100)
    monkeypatch.setattr(knn, "PROBES", 50)
    monkeypatch.setattr(knn, "TILE_ROWS", 300)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(900, 24)).round(3)
    x[800:] = x[:100]
    x[:12] = x[0]
    fold = np.arange(900) % 3
    calls, tiles, within = [], knn._search_tiles, knn._down_within
    monkeypatch.setattr(knn, "_search_tiles", lambda *a: calls.append("tiles") or tiles(*a))
    monkeypatch.setattr(knn, "_down_within", lambda rows, *a: calls.append(
        rows.count()) or within(rows, *a))
    found = knn.nearest_neighbours(
        frame(spark, x, label=np.arange(900) % 4, fold=fold), frame(spark, x, "qid", fold=fold), 5,
        part=part).toPandas().sort_values(["qid", "rank"])
    # Only the probes were led into cells.
    assert calls[-1] == "tiles" and len(calls) == 2 and calls[0] < 400
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), 9)
    if part:
        d[fold[:, None] == fold[None]] = np.inf
    want = np.array([np.lexsort((np.arange(900), row))[:5] for row in d])
    assert (found["id"].to_numpy().reshape(900, 5) == want).all()


def test_rows_are_not_divided_where_the_first_level_rules_out_little(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL_ROWS", 40)
    monkeypatch.setattr(knn, "PROBED_ROWS", 100)
    monkeypatch.setattr(knn, "TILE_ROWS", 400)
    divided, divide = [], knn._divide
    monkeypatch.setattr(knn, "_divide", lambda *a: divided.append(1) or divide(*a))
    rng = np.random.default_rng(14)
    x, q = rng.normal(size=(1_000, 24)), rng.normal(size=(60, 24))
    found = knn.nearest_neighbours(
        frame(spark, x, label=np.zeros(1_000)), frame(spark, q, "qid"), 3).toPandas()
    assert found_ids(found, 60) == brute(x, q, 3) and not divided
    # Along a line the bounds rule out nearly all, in many columns, too.
    line = np.linspace(0, 1, 1_000)[:, None] * np.ones(24)
    monkeypatch.setattr(knn, "VISIT_ROWS", 100)
    found = knn.nearest_neighbours(
        frame(spark, line, label=np.zeros(1_000)), frame(spark, line[::20], "qid"), 3).toPandas()
    assert found_ids(found, 50) == brute(line, line[::20], 3) and divided


@pytest.mark.parametrize("spread", [1.0, 1e-6, 1e25])
@pytest.mark.parametrize("parts", [1, 3])
def test_nearest_rows_of_a_tile(monkeypatch, spread, parts):
    """Ties, distances that single precision cannot tell apart or hold, few rows at a time."""
    monkeypatch.setattr(knn, "PANEL_ROWS", 70)
    monkeypatch.setattr(knn, "PANEL_QUERIES", 30)
    monkeypatch.setattr(knn, "CANDIDATES", 50)
    monkeypatch.setattr(knn, "MANY", 8)
    rng = np.random.default_rng(15)
    x = rng.integers(0, 4, (500, 6)) * spread + rng.integers(0, 2, (500, 1)) * 1_000.0
    ids, part = rng.permutation(500), rng.integers(0, parts, 500)
    q, own = x[:90], part[:90] if parts > 1 else np.full(90, 7)
    nearest = knn._Nearest((np.arange(90), q, np.zeros(90), own), 4, 9)
    for first in range(0, 500, 110):
        some = slice(first, first + 110)
        nearest.meet((ids[some], x[some], ids[some] / 2, part[some]))
    found = nearest.found()
    order = np.argsort(ids)
    d = np.round(np.sqrt(((q[:, None] - x[order][None]) ** 2).sum(axis=2)), 9)
    d[own[:, None] == part[order][None]] = np.inf
    want = np.array([np.lexsort((np.arange(500), row))[:4] for row in d])
    assert (found["id"].to_numpy(np.int64).reshape(90, 4) == want).all()
    assert (found["label"] == found["id"] / 2).all()
    assert (found["distance"].to_numpy().reshape(90, 4) == np.take_along_axis(d, want, 1)).all()


def test_packed_rows_come_back(spark):
    """Doubles that floats cannot hold, missing labels and keys; what is no number leaves."""
    for x in (np.arange(12.0).reshape(4, 3), np.arange(12.0).reshape(4, 3) / 3):
        x[3, 1] = np.nan
        keys, labels = [5, None, 2**60 + 1, 7], [1.0, 2.0, None, 3.0]
        rows = spark.createDataFrame(
            [(k, v.tolist(), y, 0) for k, v, y in zip(keys, x, labels)],
            "key long, vec array<double>, label double, part long")
        got = {}
        for piece in knn._packed(rows, 2).toPandas().itertuples(index=False):
            for key, v, y, part in zip(*knn._unpacked(*piece[1:], 3)):
                got[int(key)] = (v.tolist(), y, part)
        assert got.keys() == {5, knn.NO_KEY, 2**60 + 1} and np.isnan(got[2**60 + 1][1])
        assert [got[k][0] for k in (5, knn.NO_KEY, 2**60 + 1)] == x[:3].tolist()
        assert got[5][1:] == (1.0, 0)


def test_no_piece_holds_all_children_of_many_queries():
    """Queries that go into every child leave piece by piece."""
    rng = np.random.default_rng(12)
    x, pivots = rng.normal(size=(2_000, 64)), rng.normal(size=(256, 64))
    queries = pd.DataFrame({"key": np.arange(2_000), "vec": list(x), "part": 0, "home": 0,
                            "bound": np.inf, "cell": 0})
    children = pd.DataFrame({"_cell": np.arange(256), "_pivot": list(pivots), "_radius": 9.0,
                             "_low": list(pivots - 9), "_high": list(pivots + 9)})
    sizes = [len(part) for part in knn._may_hold("euclidean", 1e-9)(queries, children)]
    assert sum(sizes) == 2_000 * 256 and max(sizes) * 64 <= 2_000_000


@pytest.mark.parametrize("kind", ["regression", "classification"])
def test_folds_ask_equal_rows_once(spark, monkeypatch, kind):
    """The score of every fold counts all rows, though equal ones are one query."""
    rng = np.random.default_rng(13)
    pdf = pd.DataFrame({"a": rng.integers(0, 6, 600) * 1.0, "b": rng.integers(0, 5, 600) * 1.0})
    pdf["y"] = (pdf.a * 2 + rng.integers(0, 3, 600)) if kind == "regression" else (
        (pdf.a + rng.integers(0, 3, 600)) > 3) * 1.0
    asked, search = [], models.nearest_neighbours
    monkeypatch.setattr(models, "nearest_neighbours", lambda train, queries, *a, **how: (
        asked.append(queries.count()), search(train, queries, *a, **how))[1])
    data = split.prepare(spark.createDataFrame(pdf), "y", kind, ["a", "b"])
    got = models.cross_validate(data, "KNN", 3)["scores"]
    assert asked and asked[0] <= 3 * 30
    local = data.rows.withColumn("fold", split.fold_of(3)).toPandas()
    for i in range(3):
        train, test = local[local.fold != i], local[local.fold == i]
        d = np.sqrt(((test[["_f0", "_f1"]].to_numpy()[:, None]
                      - train[["_f0", "_f1"]].to_numpy()[None]) ** 2).sum(axis=2)).round(9)
        near = [train["label"].to_numpy()[np.lexsort((train["_row"], row))[:5]] for row in d]
        y = test["label"].to_numpy()
        if kind == "regression":
            p = np.mean(near, axis=1)
            want = 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
        else:
            p = np.array([np.bincount(n.astype(int)).argmax() for n in near])
            want = (y == p).mean()
        assert got[i] == pytest.approx(want, abs=1e-4)


def test_groups_are_searched_apart(spark):
    rng = np.random.default_rng(2)
    x, g = rng.normal(size=(300, 2)), rng.integers(0, 3, 300)
    rows = frame(spark, x, label=np.zeros(300), g=g)
    found = knn.nearest_neighbours(rows, frame(spark, x, "qid", g=g), 4, group="g").toPandas()
    assert found_ids(found, 300) == brute(x, x, 4, apart=g[:, None] == g[None, :])


def test_ids_beyond_doubles(spark):
    ids = [2**60 + 1, 2**60 + 2, 2**60 + 3]
    train = spark.createDataFrame([(i, [float(j)], 0.0) for j, i in enumerate(ids)],
                                  "id long, vec array<double>, label double")
    queries = spark.createDataFrame([(2**61 + 7, [0.9])], "qid long, vec array<double>")
    got = knn.nearest_neighbours(train, queries, 2).orderBy("rank").collect()
    assert [(r.qid, r.id) for r in got] == [(2**61 + 7, ids[1]), (2**61 + 7, ids[0])]


@pytest.mark.parametrize("kind, target", [("classification", "c"), ("regression", "y")])
def test_fold_scores_equal_a_fit_per_fold(spark, kind, target):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.integers(0, 20, 300) * 1.0, "b": rng.normal(size=300)})
    pdf["y"], pdf["c"] = pdf.a + pdf.b, (pdf.a > 9).astype(int)
    data = split.prepare(spark.createDataFrame(pdf), target, kind, ["a", "b"])
    one = models.cross_validate(data, "KNN", 3)["scores"]
    rows, each = data.rows.withColumn("_fold", split.fold_of(3)), []
    for i in range(3):
        fitted = models.fit(rows.filter(F.col("_fold") != i), data, "KNN")
        held = models._scored(fitted, rows.filter(F.col("_fold") == i), data)
        each.append(models._evaluate(held, data)[models._cv_metric(data)])
    assert one == pytest.approx(each, abs=2e-4)


# ---------------------------------------------------------------- mutual information


def psi(n):
    return -0.5772156649015329 + sum(1 / j for j in range(1, int(n)))


def brute_information(x, y, k=3):
    dx, dy = np.abs(x[:, None] - x[None]), np.abs(y[:, None] - y[None])
    joint = np.maximum(dx, dy)
    np.fill_diagonal(joint, np.inf)
    far = np.sort(joint, axis=1)[:, k - 1][:, None]
    nx, ny = (dx < far * (1 - 1e-9)).sum(1), (dy < far * (1 - 1e-9)).sum(1)
    found = psi(len(x)) + psi(k) - np.mean([psi(a) + psi(b) for a, b in zip(nx, ny)])
    return max(0.0, found)


def brute_class_information(x, c, k=3):
    kept = np.isin(c, [v for v in set(c) if (c == v).sum() > 1])
    x, c = x[kept], c[kept]
    total = []
    for xi, ci in zip(x, c):
        own = np.sort(np.abs(x[c == ci] - xi))
        at = min(k, len(own) - 1)
        near = (np.abs(x - xi) < own[at] * (1 - 1e-9)).sum()
        total.append(psi(at) - psi(len(own)) - psi(near))
    return max(0.0, psi(len(x)) + np.mean(total))


def scores(df, *args, **how):
    return {r.feature: r.mutual_info for r in
            information.neighbour_mutual_information(df, *args, **how).collect()}


def test_information_between_numbers(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2_000, 3))
    y = x[:, 0] ** 2 + 0.3 * x[:, 1] + 0.1 * rng.normal(size=2_000)
    pdf = pd.DataFrame({"a": x[:, 0], "b.c": x[:, 1], "noise": x[:, 2], "y": y})
    got = scores(spark.createDataFrame(pdf), "y")
    for name in ("a", "b.c", "noise"):
        want = brute_information(*((pdf[c] / pdf[c].std(ddof=0)).to_numpy() for c in (name, "y")))
        assert got[name] == pytest.approx(want, abs=2e-3)
    assert got["a"] > 1 > got["noise"]


def test_information_with_a_class(spark):
    rng = np.random.default_rng(5)
    c = np.where(rng.uniform(size=2_000) < 1 / 3, "hot", rng.choice(list("pqr"), 2_000)).astype(object)
    c[:1] = "once"
    c[1:3] = "twice"
    x = rng.normal(size=(2_000, 2)) + np.array([{"hot": 3, "p": 0, "q": 1}.get(v, 5) for v in c])[:, None] * [1, 0]
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": c})
    got = scores(spark.createDataFrame(pdf), "c", "classification")
    for name in ("a", "b"):
        want = brute_class_information(pdf[name].to_numpy() / pdf[name].std(ddof=0), c)
        assert got[name] == pytest.approx(want, abs=2e-3)
    assert got["a"] > 0.5 > got["b"]


def test_information_of_few_equal_values(spark, monkeypatch):
    """A feature that fixes the target tells its entropy, also with many equal rows and ranges."""
    from vistrata.operators import ordered

    monkeypatch.setattr(ordered, "RANGE_ROWS", 500)
    df = spark.range(1_200).selectExpr("id % 6 * 1.0D AS a", "id % 6 * 2.0D AS y",
                                       "hash(id) % 7 * 1.0D AS free")
    got = scores(df, "y")
    assert got["a"] == pytest.approx(np.log(6), abs=0.15) and got["free"] < 0.15


def test_information_of_too_few_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 4, "x double, y double")
    assert scores(df, "y") == {}
    assert scores(spark.createDataFrame([], "x double, y double"), "y") == {}


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 1_000])
def test_digamma(spark, n):
    value = spark.range(1).select(information.digamma(F.lit(n)).alias("d")).first().d
    assert value == pytest.approx(psi(n), abs=1e-10)


# ---------------------------------------------------------------- support vector regression


@pytest.fixture(scope="module")
def waves(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(-2, 2, (700, 2))
    y = 3 * np.sin(2 * x[:, 0]) + x[:, 1] + 0.05 * rng.normal(size=700)
    pdf = pd.DataFrame({"a": x[:, 0].round(1), "b": x[:, 1].round(1), "y": y.round(1)})
    return spark.createDataFrame(pd.concat([pdf, pdf.iloc[:100]])).cache()


def dual_table(waves):
    data = split.prepare(waves, "y", "regression", ["a", "b"])
    return trees.Table.of(data.rows.withColumn("_part", F.lit(0)), data.inputs, 0)


def primal(solution, table):
    local = table.frame.toPandas()
    x = solution.settings.features(local[table.inputs].to_numpy())
    loss = np.maximum(np.abs(local.label - table.middle - x @ solution.weights) - 0.1, 0)
    return (local["_count"] * loss).sum() + solution.weights @ solution.weights / 2


@pytest.mark.parametrize("large", [False, True])
def test_duality_gap_closes(waves, large, monkeypatch):
    if large:
        monkeypatch.setattr(trees, "TASK_ROWS", 100)
    table = dual_table(waves)
    assert (table.shared is None) == large
    how = dual.Settings(24, 0.5, 42)
    found = dual.fit_all(table, {0: (frozenset([0]), frozenset([0]), how)}, 1e-3)[0]
    assert 0 <= found.gap <= 1e-3 and found.score > 0.97
    # No other weights do better by more than the gap allows.
    best = primal(found, table)
    rng = np.random.default_rng(0)
    for size in (1e-3, 1e-2, 0.1):
        moved = dual.Solution(how, found.weights + size * rng.normal(size=25), 0.0, found.middle)
        assert primal(moved, table) >= best * (1 - 1e-3)


def test_support_vector_regression_is_its_name(spark, waves):
    """Errors within epsilon cost nothing: the fit ignores them."""
    model = models.train_model(waves, "y", "SVR", feature_cols=["a", "b"], cv_folds=3)
    assert model.metrics["r2"] > 0.95 and min(model.cv_scores["scores"]) > 0.9
    stage = model.fitted.stages[-1]
    assert isinstance(stage, dual.LinearScore) and len(stage.getOrDefault("weights")) == 256
    scaled = models.train_model(waves, "y", "SVR", feature_cols=["a", "b"], cv_folds=0,
                                scale_features=True)
    assert scaled.metrics["r2"] > 0.95


@pytest.mark.parametrize("name,kind,target", [
    ("SVR", "regression", "y"), ("SVM", "classification", "side")])
@pytest.mark.parametrize("scaled", [False, True])
def test_scores_of_kernel_models_hold_no_column_of_features(
        spark, waves, name, kind, target, scaled):
    rows = waves.withColumn("side", F.when(F.col("y") > 0, "up").otherwise("down"))
    model = models.fit_all(rows, target, name, kind, ["a", "b"], scaled)
    asked = rows.select(F.col("a").alias("_f0"), F.col("b").alias("_f1"))
    found, staged = models.score(model.fitted, asked), model.fitted.transform(asked)
    assert count_nodes(found, "ArrowEvalPython") == 1 and "zip_with" not in plan_text(found)
    assert "features" not in found.columns and "_judged" not in found.columns
    for got, want in zip(found.collect(), staged.select(*found.columns).collect()):
        assert got.prediction == pytest.approx(want.prediction, rel=1e-9, abs=1e-9)
        if kind == "classification":
            assert got._probability == pytest.approx(want._probability, rel=1e-9)
    assert models.score(model.fitted, asked.limit(0)).collect() == []


def test_kernel_moments_come_from_counted_rows(spark, waves):
    data = split.prepare(waves.unionByName(waves).unionByName(waves), "y", "regression", ["a", "b"])
    table = models._tree_table(data, data.rows, 3)
    assert table.n < data.rows.count()
    counted = gram.moments_by_part(table.frame, data.inputs, F.col("_part"), F.col("_count"))
    each = gram.moments_by_part(data.rows, data.inputs, split.fold_of(3) * 2)
    assert counted.keys() == each.keys()
    for part, found in counted.items():
        assert found.n == each[part].n
        for a, b in zip(found.centred(), each[part].centred()):
            assert np.allclose(a + (found.middle if a.ndim == 1 else 0),
                               b + (each[part].middle if b.ndim == 1 else 0), rtol=1e-9, atol=1e-7)


def test_random_features_approach_the_kernel():
    x = np.random.default_rng(0).normal(size=(20, 3))
    z = random_features(3, 20_000, 0.3, 1)(x)
    want = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert z @ z.T == pytest.approx(want, abs=0.05)


# ---------------------------------------------------------------- support vector classes


@pytest.fixture(scope="module")
def three(spark):
    """Three classes that overlap, on a grid with repeated rows."""
    rng = np.random.default_rng(7)
    kind = rng.integers(0, 3, 450)
    x = np.array([[0, 0], [2, 0], [0, 2]])[kind] + rng.normal(0, 0.8, (450, 2))
    pdf = pd.DataFrame({"a": x[:, 0].round(1), "b": x[:, 1].round(1), "kind": kind})
    return spark.createDataFrame(pdf).cache()


def test_support_vectors_have_probabilities_of_three_classes(three):
    model = models.train_model(three, "kind", "SVM", "classification", cv_folds=3,
                               params={"size": 32})
    assert model.metrics["accuracy"] > 0.8 and min(model.cv_scores["scores"]) > 0.75
    rows = model.predict(three).select("kind", "probabilities").collect()
    p, y = np.array([r.probabilities for r in rows]), np.array([r.kind for r in rows])
    assert p.sum(axis=1) == pytest.approx(1) and (p >= 0).all()
    shares = np.bincount(y) / len(y)
    loss = -np.log(p[np.arange(len(y)), y]).mean()
    assert loss < 0.6 * -(shares * np.log(shares)).sum()


def test_large_tables_find_the_same_classes(three, monkeypatch):
    how = dual.Settings(16, 0.5, 42)
    # Fits that are scored have no sigmoids.
    fits = {0: (frozenset([0]), frozenset([0]), how), 1: (frozenset([0]), None, how)}

    def run():
        data = split.prepare(three.filter("kind < 2"), "kind", "classification", ["a", "b"])
        table = trees.Table.of(data.rows.withColumn("_part", F.lit(0)), data.inputs, 2)
        return dual.classify_all(table, fits, 1e-2)

    a, a_score = run()
    monkeypatch.setattr(dual, "WHOLE_FEATURES", 0)
    b, b_score = run()
    assert a_score[0] == pytest.approx(b_score[0], abs=0.02) and a_score[0] > 0.85
    x = how.features(np.random.default_rng(1).uniform(-1, 3, (200, 2)))[:, :-1]
    assert np.abs(a[1].judge(x)[1] - b[1].judge(x)[1]).max() < 0.15


def test_sigmoid_recovers_its_parameters():
    rng = np.random.default_rng(2)
    margin = rng.normal(size=20_000)
    positive = rng.uniform(size=20_000) < 1 / (1 + np.exp(-2.0 * margin + 0.5))
    assert dual.fit_sigmoid(margin, positive, np.ones(20_000)) == pytest.approx((-2.0, 0.5), abs=0.1)


def test_coupling_returns_consistent_pairs():
    p = np.array([[0.5, 0.3, 0.2], [0.1, 0.1, 0.8]])
    pairwise = p[:, :, None] / (p[:, :, None] + p[:, None, :])
    assert dual.coupled(pairwise) == pytest.approx(p, abs=1e-6)
