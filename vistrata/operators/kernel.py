"""Approximate RBF kernel features, so that linear solvers fit kernel models.

Random Fourier features (Rahimi and Recht, "Random features for large-scale
kernel machines", NIPS 2007): cos(w.x + b) with Gaussian w. The frequencies
follow from the seed, so the stage is saved by its parameters alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F


def random_features(n_inputs: int, size: int, gamma: float, seed: int):
    """The map to ``size`` random features of the kernel; the same for equal arguments."""
    draw = np.random.default_rng(seed)
    w = draw.normal(0.0, np.sqrt(2.0 * gamma), (n_inputs, size))
    b = draw.uniform(0.0, 2.0 * np.pi, size)
    return lambda x: np.sqrt(2.0 / size) * np.cos(x @ w + b)


class RandomFourierFeatures(
    Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable
):
    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "width of the kernel", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, size=256, gamma=1.0, seed=42):
        super().__init__()
        self._setDefault(size=256, gamma=1.0)
        self._set(**self._input_kwargs)

    def lift(self):
        """What makes random features of an array of vectors; drawn once for a task."""
        size, gamma, seed = (self.getOrDefault(p) for p in (self.size, self.gamma, self.seed))
        drawn = []

        def to_features(x: np.ndarray) -> np.ndarray:
            if not drawn:
                drawn.append(random_features(x.shape[1], size, gamma, seed))
            return drawn[0](x)

        return to_features

    def _transform(self, dataset: DataFrame) -> DataFrame:
        to_features = self.lift()

        @F.pandas_udf("array<double>")
        def lift(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for vectors in batches:
                if not len(vectors):
                    yield pd.Series([], dtype=object)
                    continue
                yield pd.Series(list(to_features(np.stack(vectors.to_numpy()))))

        lifted = lift(vector_to_array(F.col(self.getInputCol())))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(lifted))
