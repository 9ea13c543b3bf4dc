"""Sums of long vectors of doubles, sent as bytes and added as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def sum_vectors(sent: DataFrame, keys: list[str], column: str = "sums") -> DataFrame:
    """The sum of the packed vectors of each key; the keys are long columns.

    The rows of a key meet sorted and are added one by one, so it does not matter how
    many tasks sent one.
    """
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total, out = None, None, []
        for batch in batches:
            for *key, packed in batch[[*keys, column]].itertuples(index=False):
                if key != at:
                    if at is not None:
                        out.append((*at, total.tobytes()))
                    at, total = key, np.zeros(len(packed) // 8)
                total += np.frombuffer(packed)
            if len(out) > 100:
                yield pd.DataFrame(out, columns=[*keys, column])
                out = []
        if at is not None:
            out.append((*at, total.tobytes()))
        if out:
            yield pd.DataFrame(out, columns=[*keys, column])

    schema = ", ".join([*[f"{k} long" for k in keys], f"{column} binary"])
    return sent.select(*keys, column).repartition(*keys).sortWithinPartitions(*keys).mapInPandas(
        add, schema)
