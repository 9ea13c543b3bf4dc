"""Count-min sketches of 64-bit keys, gathered sparsely and merged by blocks.

A task turns its keys into the cells they hit, one row of cells per hash
function, sorts them and sends each block of 65,536 cells as the steps from one to
the next, mostly one byte per key and row, so the traffic follows the keys and not
the width. The blocks of all tasks are summed as a stream; what is kept of a sum is whether it
reaches a limit. The merged table is one bit per cell, at most ``MAX_WIDTH`` cells a
row, and so has a proven size wherever it is broadcast. With more keys than that has
room for, more estimates are too high; none is ever too low.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vistrata.llm.wordhash import mixed, numbers

BLOCK = 1 << 16
DEPTH = 2
# 32 MB a row.
MAX_WIDTH = 1 << 28
# Cells that share a bit of the second, higher limit.
COARSE = 64
# Keys that a task gathers before it sends their cells.
GATHERED = 4_000_000

CELLS = "part int, block int, cells binary"


def width_for(n_keys: int, cells_per_key: float = 2.0, most: int = MAX_WIDTH) -> int:
    """A power of two of about so many cells per key, within the bound."""
    wanted = max(BLOCK, int(n_keys * cells_per_key))
    return min(most, 1 << (wanted - 1).bit_length())


def cells_of(keys: np.ndarray, part: int, width: int) -> np.ndarray:
    """The cell of every key in one row of the sketch."""
    salt = numbers(DEPTH + 1, 901)[part]
    return (mixed(keys ^ salt) >> np.uint64(64 - (width.bit_length() - 1))).astype(np.uint32)


def sparse_cells(chunks: Iterator[np.ndarray], width: int) -> Iterator[pd.DataFrame]:
    """Rows ``part, block, cells`` of all keys that come in ``chunks``."""
    held, n = [], 0
    for keys in chunks:
        held.append(keys)
        n += len(keys)
        if n >= GATHERED:
            yield from _packed(np.concatenate(held), width)
            held, n = [], 0
    if n:
        yield from _packed(np.concatenate(held), width)


def _packed(keys: np.ndarray, width: int) -> Iterator[pd.DataFrame]:
    for part in range(DEPTH):
        cells = cells_of(keys, part, width)
        cells.sort()
        blocks = cells // BLOCK
        first = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1])))
        steps = np.diff(cells, prepend=cells[:1])
        steps[first] = cells[first] % BLOCK
        # A step above 254 is that many bytes 255 (each worth 255) and the rest.
        jumps, rest = np.divmod(steps, 255)
        ends = np.cumsum(jumps + 1, dtype=np.int64)
        packed = np.full(int(ends[-1]), 255, np.uint8)
        packed[ends - 1] = rest
        packed = packed.tobytes()
        bounds = [0, *ends[first[1:] - 1], len(packed)]
        yield pd.DataFrame({
            "part": np.int32(part), "block": blocks[first].astype(np.int32),
            "cells": [packed[a:b] for a, b in zip(bounds, bounds[1:])]})


def unpacked(packed: bytes) -> np.ndarray:
    """The cells within a block, from their steps."""
    steps = np.frombuffer(packed, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


class Sketch:
    """Which cells reach ``limit``, and which groups of cells reach ``high``, as bits."""

    def __init__(self, width: int):
        self.width = width
        self.bits = np.zeros((DEPTH, width // 8), np.uint8)
        self.high = np.zeros((DEPTH, width // COARSE // 8), np.uint8)

    def _holds(self, table: np.ndarray, keys: np.ndarray, coarse: int) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for part in range(DEPTH):
            cells = cells_of(keys, part, self.width) // coarse
            out &= (table[part][cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1
        return out

    def reaches(self, keys: np.ndarray) -> np.ndarray:
        """Whether the estimate of each key is at least ``limit``; never too low."""
        return self._holds(self.bits, keys, 1)

    def reaches_high(self, keys: np.ndarray) -> np.ndarray:
        """Whether the coarser estimate of each key is at least ``high``; never too low."""
        return self._holds(self.high, keys, COARSE)


def merge(cells: DataFrame, width: int, limit: int, high: int | None = None) -> Sketch:
    """Sum the packed cells of all tasks and fetch the bits of the merged sketch.

    A block is summed row by row, so it does not matter how many tasks sent one.
    The driver gets ``DEPTH * width / 8`` bytes, and 1/64 more for ``high``.
    """
    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sums = None, None
        for batch in batches:
            for part, block, packed in zip(batch["part"], batch["block"], batch["cells"]):
                if at != (part, block):
                    if at is not None:
                        yield _bits(at, sums, limit, high)
                    at, sums = (part, block), np.zeros(BLOCK, np.int64)
                sums += np.bincount(unpacked(packed), minlength=BLOCK)
        if at is not None:
            yield _bits(at, sums, limit, high)

    merged = cells.repartition("part", "block").sortWithinPartitions("part", "block")
    schema = "part int, block int, bits binary, high binary"
    out = Sketch(width)
    for row in merged.mapInPandas(summed, schema).collect():
        for table, found in ((out.bits, row["bits"]), (out.high, row["high"])):
            if found is not None:
                first = row["block"] * len(found)
                table[row["part"], first:first + len(found)] = np.frombuffer(found, np.uint8)
    return out


def _bits(at, sums: np.ndarray, limit: int, high: int | None) -> pd.DataFrame:
    def packed(full: np.ndarray) -> bytes | None:
        return np.packbits(full, bitorder="little").tobytes() if full.any() else None

    coarse = None if high is None else packed(sums.reshape(-1, COARSE).max(axis=1) >= high)
    return pd.DataFrame({"part": [at[0]], "block": [at[1]], "bits": [packed(sums >= limit)],
                         "high": [coarse]}).astype({"part": np.int32, "block": np.int32})


def count_sketch(rows: DataFrame, keys_of: Callable[[Iterator], Iterator[np.ndarray]],
                 width: int, limit: int, high: int | None = None) -> Sketch:
    """The merged sketch of the keys that ``keys_of`` makes of the batches of ``rows``."""
    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from sparse_cells(keys_of(batches), width)

    return merge(rows.mapInPandas(gather, CELLS), width, limit, high)


def count_rows(frame: DataFrame, column: str) -> int:
    """The sum of a column of counts, 0 for no rows."""
    return int(frame.agg(F.coalesce(F.sum(column), F.lit(0))).first()[0])
