"""Leading eigenvalues without a matrix of columns by columns."""

import numpy as np
import pandas as pd
import pytest

from vistrata.operators import association


def leading(df, count):
    return association.leading_eigenvalues(df, count).orderBy("pc").collect()


def test_wide_table(spark):
    rng = np.random.default_rng(0)
    common = rng.normal(size=(700, 6)) @ rng.normal(size=(6, 300)) * np.linspace(0.2, 1, 300)
    x = (common + rng.normal(size=(700, 300))) * 10.0 ** rng.integers(-3, 4, 300) + 50
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(300)]))
    rows = leading(df, 8)
    want = np.linalg.eigvalsh(np.corrcoef(x.T))[::-1][:8]
    assert [r.eigenvalue for r in rows] == pytest.approx(want, abs=2e-4)
    assert [r.explained_pct for r in rows] == pytest.approx(want / 3, abs=0.006)


def test_equals_the_whole_scree(sample):
    whole = association.eigen_scree(sample).orderBy("pc").collect()
    assert [tuple(r)[:2] for r in leading(sample, 10)] == [tuple(r)[:2] for r in whole]


def test_edges(spark, tiny):
    assert leading(tiny("empty"), 3) == leading(tiny("missing"), 3) == []
    same = spark.range(50).selectExpr("id * 1.0D AS a", "id * 2.0D AS `b.c`", "7.0D AS d")
    assert [r.eigenvalue for r in leading(same, 3)] == [2.0, 0.0]
