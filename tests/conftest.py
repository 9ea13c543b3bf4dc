import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vistrata.plans.session import local_session  # noqa: E402
from vistrata.sources.files import from_pandas  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sample_pdf() -> pd.DataFrame:
    """100 people with missing ages and categories, one extreme salary, 3 repeated rows."""
    rng = np.random.default_rng(42)
    n = 100
    pdf = pd.DataFrame({
        "age": rng.integers(18, 80, n).astype(float),
        "salary": rng.normal(55_000, 15_000, n),
        "score": rng.uniform(0, 100, n),
        "category": rng.choice(list("ABCD"), n).astype(object),
        "flag": rng.choice([True, False], n),
        "city": rng.choice(["Oslo", "Rome", "Lima", "Cairo"], n),
    })
    pdf.loc[rng.choice(n, 10, replace=False), "age"] = np.nan
    pdf.loc[rng.choice(n, 5, replace=False), "category"] = None
    pdf.loc[0, "salary"] = 1_000_000.0
    return pd.concat([pdf, pdf.iloc[:3]], ignore_index=True)


@pytest.fixture(scope="session")
def sample(spark, sample_pdf):
    return from_pandas(spark, sample_pdf).cache()


@pytest.fixture(scope="session")
def skewed_pdf() -> pd.DataFrame:
    """A third of the rows share one value, key and text; the rest is spread out."""
    rng = np.random.default_rng(3)
    n = 6_000
    hot = rng.uniform(size=n) < 1 / 3
    value = np.where(hot, 7.0, rng.normal(0, 1_000, n).round(3))
    group = np.where(hot, "hot", rng.choice([f"g{i:03d}" for i in range(400)], n))
    other = np.where(hot, 1.0, rng.exponential(5, n).round(2))
    pdf = pd.DataFrame({"value": value, "grp": group, "other": other})
    pdf.loc[rng.choice(n, 300, replace=False), "grp"] = None
    pdf.loc[rng.choice(n, 200, replace=False), "value"] = np.nan
    return pdf


@pytest.fixture(scope="session")
def skewed(spark, skewed_pdf):
    return from_pandas(spark, skewed_pdf).cache()


@pytest.fixture
def tiny(spark):
    """Edge inputs by name."""
    def make(name: str):
        frames = {
            "empty": ([], "x double, c string"),
            "one": ([(1.5, "a")], "x double, c string"),
            "missing": ([(None, None), (None, None)], "x double, c string"),
            "constant": ([(2.0, "a"), (2.0, "a"), (2.0, "a")], "x double, c string"),
            "nan": ([(float("nan"), "a"), (None, "b"), (1.0, "b"), (4.0, None)],
                    "x double, c string"),
        }
        rows, schema = frames[name]
        return spark.createDataFrame(rows, schema)
    return make
