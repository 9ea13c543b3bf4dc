"""Small helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The fixed white space of words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD_SPLIT = "[ \\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# A group is hot when it holds more than one row in so many; there can be no more hot groups.
HOT_GROUPS = 1_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """The words of a text; none for NULL and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, WORD_SPLIT)
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside higher-order functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, n_rows: Column, total: int
                ) -> DataFrame:
    """Inner join of ``rows`` with one row per group, hot groups by broadcast.

    ``n_rows`` is the group's number of rows in ``rows`` and ``total`` the rows
    in all, so at most ``HOT_GROUPS`` groups are broadcast and no key that is
    left to the shuffle holds more than that share of the rows.
    """
    heavy = n_rows > F.lit(total / HOT_GROUPS)
    hot = F.broadcast(groups.filter(heavy))
    near = rows.join(hot, key)
    far = rows.join(hot.select(key), key, "left_anti").join(groups.filter(~heavy), key)
    return near.unionByName(far)


# Counters that are sent to the driver as one value.
PACK = 1 << 14


def packed_counts(counts: DataFrame, size: int) -> dict[str, np.ndarray]:
    """Tables of ``size`` counters by name, from rows of ``name, counter, n``.

    The rows are summed and packed by tasks, so the driver gets a few arrays of
    bytes per name, in single precision, and not a row per counter.
    """
    summed = counts.groupBy("name", "counter").agg(F.sum("n").alias("n"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        dense = np.zeros(PACK, np.float32)
        dense[part["counter"].to_numpy(int) % PACK] = part["n"]
        first = int(part["counter"].iloc[0]) // PACK
        return pd.DataFrame({"name": [part["name"].iloc[0]], "place": [first],
                             "dense": [dense.tobytes()]})

    packed = summed.withColumn("place", F.floor(F.col("counter") / PACK)).groupBy(
        "name", "place").applyInPandas(pack, "name string, place long, dense binary")
    out: dict[str, np.ndarray] = {}
    for row in packed.collect():
        table = out.setdefault(row["name"], np.zeros(size))
        part = np.frombuffer(row["dense"], np.float32)[:size - row["place"] * PACK]
        table[row["place"] * PACK:row["place"] * PACK + len(part)] = part
    return out


BLOCKS = "name string, place long, counts binary"


def counter_blocks(name: str, found: np.ndarray) -> pd.DataFrame:
    """A task's table of counters as a few compressed rows (``BLOCKS``), blocks of zeros left out."""
    pack = zstandard.ZstdCompressor(level=1)
    parts = [(place, found[place * PACK:(place + 1) * PACK])
             for place in range(-(-len(found) // PACK))]
    rows = [(name, place, pack.compress(part.astype("<i8").tobytes()))
            for place, part in parts if part.any()]
    return pd.DataFrame(rows, columns=["name", "place", "counts"])


def summed_blocks(blocks: DataFrame, size: int) -> dict[str, np.ndarray]:
    """Tables of ``size`` counters by name, from the rows of ``counter_blocks`` of all tasks.

    The rows of a block are added one by one, however many tasks sent one; the driver gets
    one row per block, in single precision.
    """
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack, at, total = zstandard.ZstdDecompressor(), None, None

        def done() -> pd.DataFrame:
            dense = total.astype(np.float32).tobytes()
            return pd.DataFrame({"name": [at[0]], "place": [at[1]], "counts": [dense]})

        for batch in batches:
            for name, place, counts in batch.itertuples(index=False):
                if at != (name, place):
                    if at is not None:
                        yield done()
                    at, total = (name, place), 0
                total = total + np.frombuffer(unpack.decompress(counts), "<i8")
        if at is not None:
            yield done()

    out: dict[str, np.ndarray] = {}
    met = blocks.repartition("name", "place").sortWithinPartitions("name", "place")
    for row in met.mapInPandas(add, BLOCKS).collect():
        table = out.setdefault(row["name"], np.zeros(size))
        part = np.frombuffer(row["counts"], np.float32)[:size - row["place"] * PACK]
        table[row["place"] * PACK:row["place"] * PACK + len(part)] = part
    return out
