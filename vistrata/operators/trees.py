"""Decision trees, forests and boosting, grown on one table of distinct rows.

All fits of a model (the training rows and every cross-validation fold) and all its
trees share one table: the distinct rows with their number in each part of the split.
A tree is grown level by level, all nodes of a level together, without a limit of
depth.

* A node whose rows fit a task is finished there by exact cuts between neighbouring
  values. Where the whole table fits, it is broadcast (its size is checked) and the
  tasks share out the trees.
* Above that, levels are grown over the whole table: each task sums histograms of the
  cut features for all open nodes, the sums meet in a shuffle that also finds the best
  cut, and only cuts reach the driver. The rows of nodes that have become small enough
  are then sent to the task that finishes them. Features with more than ``BINS`` values
  are cut at quantiles in these upper levels.

Random choices (the weight of a row in a bootstrap sample, the features a node may use)
are functions of the row, the tree and the node, so both ways draw the same.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vistrata.operators.quantiles import exact_quantiles
from vistrata.plans.session import materialise

# Rows that a task may grow a tree on, and bytes of the table of values they make.
TASK_ROWS = 200_000
TASK_BYTES = 64 << 20
# Cells of the histograms that a task holds at a time in the upper levels.
HISTOGRAM_CELLS = 4 << 20
BINS = 256
# Trees of a fit that one task grows and adds up.
TREES_PER_TASK = 10
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NO_CUT = 1e-10


def scramble(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that looks random."""
    x = np.asarray(x, np.uint64).copy()
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (scramble(x) >> np.uint64(11)).astype(float) / float(1 << 53)


def bootstrap_weights(rows: np.ndarray, counts: np.ndarray, seed: int) -> np.ndarray:
    """How often each distinct row is drawn: Poisson with its count as the mean."""
    draw = rows ^ scramble(np.array([seed], np.uint64) * _STEP)
    u = _uniform(draw)
    out = np.zeros(len(rows))
    few = counts <= 30
    term = np.exp(-counts[few])
    below = term.copy()
    left = u[few] >= below
    got = np.zeros(len(term))
    step = 0
    while left.any() and step < 200:
        step += 1
        got[left] = step
        term = term * counts[few] / step
        below = below + term
        left &= u[few] >= below
    out[few] = got
    many = ~few & (counts > 0)
    second = _uniform(draw[many] + np.uint64(1))
    normal = np.sqrt(-2 * np.log1p(-u[many])) * np.cos(2 * np.pi * second)
    out[many] = np.maximum(0, np.round(counts[many] + np.sqrt(counts[many]) * normal))
    out[counts <= 0] = 0
    return out


# -- one tree -------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes in the order they were made; the children of a node are neighbours.

    ``feature`` is -1 at a leaf. ``value`` holds the means of the node, ``gain`` what
    its cut took off the impurity, ``weight`` its weight.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    weight: np.ndarray

    def packed(self) -> bytes:
        return pickle.dumps((self.feature, self.threshold, self.left, self.value, self.gain,
                             self.weight))

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        return cls(*pickle.loads(data))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while len(rows):
            inner = self.feature[at[rows]] >= 0
            rows = rows[inner]
            node = at[rows]
            right = x[rows, self.feature[node]] > self.threshold[node]
            at[rows] = self.left[node] + right
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(x)]

    def importances(self, n_features: int) -> np.ndarray:
        inner = self.feature >= 0
        found = np.bincount(self.feature[inner], weights=self.gain[inner], minlength=n_features)
        return found / found.sum() if found.sum() > 0 else found


@dataclass(frozen=True)
class Rules:
    depth: int | None = None
    # Features a node may use; None: all.
    features: int | None = None
    least_rows: float = 2.0


def child_keys(keys: np.ndarray, side: int) -> np.ndarray:
    return scramble(keys * np.uint64(2) + np.uint64(side + 1))


def allowed_features(keys: np.ndarray, n_features: int, rules: Rules) -> np.ndarray | None:
    """Which features each node may use: those whose draws are the least."""
    if rules.features is None or rules.features >= n_features:
        return None
    draws = scramble(keys[:, None] + np.arange(1, n_features + 1, dtype=np.uint64) * _STEP)
    border = np.partition(draws, rules.features - 1, axis=1)[:, rules.features - 1]
    return draws <= border[:, None]


def _spread(totals: np.ndarray) -> np.ndarray:
    """What is left to explain in nodes with ``totals`` of weight, values and squares."""
    return totals[:, -1] - _explained(totals)


def _explained(totals: np.ndarray) -> np.ndarray:
    return (totals[:, 1:-1] ** 2).sum(axis=1) / np.maximum(totals[:, 0], 1e-300)


def _open(totals: np.ndarray, depth: int, rules: Rules) -> np.ndarray:
    if rules.depth is not None and depth >= rules.depth:
        return np.zeros(len(totals), bool)
    return (totals[:, 0] >= rules.least_rows) & (
        _spread(totals) > _NO_CUT * np.maximum(totals[:, -1], 1e-300))


class _Nodes:
    """Collects the nodes of a tree while it grows."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.n = 0

    def add(self, totals: np.ndarray) -> np.ndarray:
        """Further leaves with their means; returns their numbers."""
        m = len(totals)
        self.parts.append((np.full(m, -1, np.int32), np.zeros(m), np.zeros(m, np.int64),
                           totals[:, 1:-1] / np.maximum(totals[:, :1], 1e-300), np.zeros(m),
                           totals[:, 0].copy()))
        self.n += m
        return np.arange(self.n - m, self.n)

    def tree(self) -> Tree:
        return Tree(*(np.concatenate(part) for part in zip(*self.parts)))


def grow(x: np.ndarray, stats: np.ndarray, rules: Rules, key: int = 1, depth: int = 0) -> Tree:
    """Grow a tree to its end by exact cuts.

    ``stats`` holds for each row its weight, one or more weighted values and their
    weighted squares. All nodes of a level are cut together: rows are kept in order of
    (node, value) for every feature, and sums along that order give both sides of every
    cut. Ties go to the first feature and the smallest cut.
    """
    kept = stats[:, 0] > 0
    x, stats = x[kept], stats[kept]
    n, p = x.shape
    nodes = _Nodes()
    totals = stats.sum(axis=0, keepdims=True) if n else np.zeros((1, stats.shape[1]))
    numbers, keys = nodes.add(totals), np.array([key], np.uint64)
    node = np.zeros(n, np.int64)
    orders = [np.argsort(x[:, j], kind="stable") for j in range(p)]
    while True:
        going = _open(totals, depth, rules)
        if not n or not going.any():
            return nodes.tree()
        feature, threshold, gain = _best_cuts(x, stats, orders, node, totals, keys, going, rules)
        cut = feature >= 0
        if not cut.any():
            return nodes.tree()
        _mark(nodes, numbers[cut], feature[cut], threshold[cut], gain[cut])
        place = np.cumsum(cut) - 1
        alive = (node >= 0) & cut[node]
        right = np.zeros(n, bool)
        rows = np.flatnonzero(alive)
        right[rows] = x[rows, feature[node[rows]]] > threshold[node[rows]]
        node = np.where(alive, 2 * place[node] + right, -1)
        orders = [_regroup(o[alive[o]], node) for o in orders]
        totals = _sums(stats, node, 2 * int(cut.sum()))
        numbers = nodes.add(totals)
        keys = np.stack([child_keys(keys[cut], 0), child_keys(keys[cut], 1)], axis=1).ravel()
        depth += 1


def _mark(nodes: _Nodes, numbers, feature, threshold, gain) -> None:
    """Turn leaves of the last level into inner nodes whose children come next."""
    last = nodes.parts[-1]
    at = numbers - (nodes.n - len(last[0]))
    last[0][at], last[1][at], last[4][at] = feature, threshold, gain
    last[2][at] = nodes.n + 2 * np.arange(len(at))


def _regroup(order: np.ndarray, node: np.ndarray) -> np.ndarray:
    return order[np.argsort(node[order], kind="stable")]


def _sums(stats: np.ndarray, node: np.ndarray, n_nodes: int) -> np.ndarray:
    inside = node >= 0
    return np.stack([np.bincount(node[inside], weights=stats[inside, k], minlength=n_nodes)
                     for k in range(stats.shape[1])], axis=1)


def _best_cuts(x, stats, orders, node, totals, keys, going, rules):
    """The best feature (or -1), threshold and gain of every node."""
    m, p = len(totals), x.shape[1]
    allowed = allowed_features(keys, p, rules)
    best = np.full((2, m), -np.inf)
    feature, threshold = np.full((2, m), -1), np.zeros((2, m))
    for j, order in enumerate(orders):
        at, value = node[order], x[order, j]
        steps = np.flatnonzero((at[1:] == at[:-1]) & (value[1:] > value[:-1]) & going[at[1:]])
        if not len(steps):
            continue
        sums = np.cumsum(stats[order], axis=0)
        first = np.searchsorted(at, np.arange(m))
        before = np.where(first[:, None] > 0, sums[np.maximum(first - 1, 0)], 0.0)
        owner = at[steps]
        low = sums[steps] - before[owner]
        high = totals[owner] - low
        found = _explained(low) + _explained(high)
        new = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        top = np.maximum.reduceat(found, new)
        hit = np.flatnonzero(found == np.repeat(top, np.diff(np.append(new, len(found)))))
        hit = hit[np.concatenate(([True], owner[hit][1:] != owner[hit][:-1]))]
        who = owner[hit]
        middle = between(value[steps[hit]], value[steps[hit] + 1])
        # Row 0: among the features a node may use; row 1: among all, where it may use none.
        for row, usable in ((0, None if allowed is None else allowed[who, j]), (1, None)):
            better = found[hit] > best[row, who] * (1 + 1e-12) + 1e-300
            better &= True if usable is None else usable
            best[row, who[better]] = found[hit][better]
            feature[row, who[better]] = j
            threshold[row, who[better]] = middle[better]
    row = np.where(feature[0] >= 0, 0, 1)
    pick = (row, np.arange(m))
    gain = np.maximum(best[pick] - _explained(totals), 0.0)
    return np.where(going, feature[pick], -1), threshold[pick], gain


# -- the shared table -----------------------------------------------------------------


@dataclass(frozen=True)
class Unit:
    """A tree to grow: the parts whose rows it learns from and its bootstrap seed."""

    fit: int
    tree: int
    parts: frozenset
    seed: int | None = None

    @property
    def key(self) -> int:
        return (self.tree + 1) * 1_000_003


@dataclass
class Rows:
    """Distinct rows in arrays: values, label, count, part and hash."""

    x: np.ndarray
    y: np.ndarray
    count: np.ndarray
    part: np.ndarray
    row: np.ndarray
    # Rows equal but for their part, where the whole table is at hand.
    group: np.ndarray | None = None

    @classmethod
    def of(cls, frame: pd.DataFrame, inputs: list[str]) -> Rows:
        return cls(frame[inputs].to_numpy(float), frame["label"].to_numpy(float),
                   frame["_count"].to_numpy(float), frame["_part"].to_numpy(np.int64),
                   frame["_hash"].to_numpy(np.int64).view(np.uint64))

    def weights(self, unit: Unit) -> np.ndarray:
        counts = np.where(np.isin(self.part, list(unit.parts)), self.count, 0.0)
        return counts if unit.seed is None else bootstrap_weights(self.row, counts, unit.seed)

    def grouped(self) -> Rows:
        """One row for those that differ in their part alone; ``group`` leads there."""
        values = np.column_stack([self.x, self.y])
        new = np.concatenate(([True], (values[1:] != values[:-1]).any(axis=1)))
        self.group = np.cumsum(new) - 1
        return Rows(self.x[new], self.y[new], *[a[new] for a in (self.count, self.part, self.row)])

    def group_weights(self, unit: Unit) -> np.ndarray:
        return np.bincount(self.group, weights=self.weights(unit))


def distinct_rows(rows: DataFrame, inputs: list[str]) -> DataFrame:
    """The distinct ``inputs, label, _part`` of ``rows`` with ``_count`` and ``_hash``."""
    names = [*inputs, "label", "_part"]
    counted = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_count"))
    return materialise(counted.withColumn("_hash", F.xxhash64(*names)), "distinct-rows")


def between(low, high):
    """The middle of two neighbouring values, or the lower one where there is none."""
    middle = (low + high) / 2
    return np.where(middle >= high, low, middle)


@dataclass
class Table:
    """The distinct rows of a problem; ``small`` holds them where they fit a task."""

    frame: DataFrame
    inputs: list[str]
    # 0 for a numeric target.
    classes: int
    n: int
    middle: float = 0.0
    # The broadcast rows and their groups, where the table is small enough for that.
    shared: object = None
    edges: list[np.ndarray] | None = None
    # All values of the features that are cut between any two of them, else None.
    values_of: list[np.ndarray | None] = field(default_factory=list)

    @classmethod
    def of(cls, rows: DataFrame, inputs: list[str], classes: int) -> Table:
        frame = distinct_rows(rows, inputs)
        seen = frame.agg(
            F.count(F.lit(1)).alias("n"), F.avg("label").alias("m"),
            F.stddev_pop("label").alias("s")).first()
        table = cls(frame, inputs, classes, seen["n"])
        if not classes and seen["n"]:
            # About the mean, on a grid of a power of 2, so that sums of whole targets stay exact.
            step = 2.0 ** math.floor(math.log2(seen["s"])) if seen["s"] else 1.0
            table.middle = round(seen["m"] / step) * step
        if table.n <= table.task_rows():
            # In one order, whatever the files, so that sums come out the same.
            local = frame.toPandas().sort_values([*inputs, "label", "_part"], kind="stable")
            rows = Rows.of(local, inputs)
            table.shared = frame.sparkSession.sparkContext.broadcast((rows, rows.grouped()))
        return table

    def task_rows(self) -> int:
        return min(TASK_ROWS, TASK_BYTES // (8 * (len(self.inputs) + 4)))

    def stats(self, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Weight, weighted values (of each class, or of the centred target) and squares."""
        if not self.classes:
            centred = y - self.middle
            return np.stack([w, w * centred, w * centred**2], axis=1)
        out = np.zeros((len(y), self.classes + 2))
        out[:, 0] = out[:, -1] = w
        out[np.arange(len(y)), y.astype(int) + 1] = w
        return out

    def values(self, means: np.ndarray) -> np.ndarray:
        return means if self.classes else means + self.middle

    def find_edges(self) -> list[np.ndarray]:
        """Cuts of every feature for the upper levels: between all values, or at quantiles.

        There are so many quantiles, and each is cut on both sides, that the rows between
        two cuts fit a task or share one value.
        """
        if self.edges is None:
            wanted = max(BINS, 4 * math.ceil(self.n / self.task_rows()))
            sizes = self.frame.agg(*[
                F.approx_count_distinct(c, 0.02).alias(c) for c in self.inputs]).first()
            many = [c for c in self.inputs if sizes[c] > 0.9 * BINS]
            found = exact_quantiles(
                self.frame, many, [i / wanted for i in range(1, wanted)]) if many else {}
            self.edges = []
            for c in self.inputs:
                if c in found:
                    cuts = np.array(found[c], float)
                    self.edges.append(np.unique([cuts, np.nextafter(cuts, -np.inf)]))
                    self.values_of.append(None)
                else:
                    values = np.array([r[0] for r in self.frame.select(c).distinct().collect()])
                    values = np.sort(values.astype(float))
                    self.edges.append(between(values[:-1], values[1:]))
                    self.values_of.append(values)
        return self.edges


# -- upper levels over the whole table ------------------------------------------------

# Gives the statistics of a block of rows for a unit: weight, values, squares.
Stats = Callable[[Rows, Unit], np.ndarray]


@dataclass
class Growing:
    """An unfinished tree: its nodes so far, and which of its leaves are still open."""

    unit: Unit
    rules: Rules
    feature: list = field(default_factory=list)
    threshold: list = field(default_factory=list)
    left: list = field(default_factory=list)
    totals: list = field(default_factory=list)
    gain: list = field(default_factory=list)
    key: list = field(default_factory=list)
    depth: list = field(default_factory=list)
    n_rows: list = field(default_factory=list)
    # Leaves that no cut of the upper levels divides.
    closed: set = field(default_factory=set)

    def open_leaves(self) -> list[int]:
        return [k for k, f in enumerate(self.feature) if f == -1 and k not in self.closed and _open(
            np.array(self.totals[k])[None], self.depth[k], self.rules)[0]]

    def add(self, totals, key: int, depth: int, n_rows: float) -> int:
        for name, value in (("feature", -1), ("threshold", 0.0), ("left", 0), ("totals", totals),
                            ("gain", 0.0), ("key", key), ("depth", depth), ("n_rows", n_rows)):
            getattr(self, name).append(value)
        return len(self.feature) - 1

    def tree(self) -> Tree:
        totals = np.array(self.totals, float)
        return Tree(np.array(self.feature, np.int32), np.array(self.threshold, float),
                    np.array(self.left, np.int64),
                    totals[:, 1:-1] / np.maximum(totals[:, :1], 1e-300),
                    np.array(self.gain, float), totals[:, 0])


def _level(table: Table, growing: list[tuple[Growing, list[int]]], stats: Stats) -> pd.DataFrame:
    """One pass: the best cut of each asked-for node of each unit."""
    inputs, edges = table.inputs, table.find_edges()
    known = table.values_of
    bins = max((len(e) for e in edges), default=0) + 1
    spark = table.frame.sparkSession
    asked = spark.sparkContext.broadcast([
        (i, g.unit, g.tree(), nodes, np.array([g.key[k] for k in nodes], np.uint64))
        for i, (g, nodes) in enumerate(growing)])
    p, rules = len(inputs), growing[0][0].rules

    def histograms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            rows = Rows.of(batch, inputs)
            places = np.stack([np.searchsorted(e, rows.x[:, j]) for j, e in enumerate(edges)], axis=1)
            for i, unit, tree, nodes, _ in asked.value:
                leaf = tree.leaves(rows.x)
                values = stats(rows, unit)
                # One more column: distinct rows that count.
                values = np.column_stack([values, values[:, 0] > 0])
                inside = values[:, 0] > 0
                for node in nodes:
                    at = np.flatnonzero(inside & (leaf == node))
                    if not len(at):
                        continue
                    cell = (places[at] + np.arange(p) * bins).ravel()
                    found = np.stack([np.bincount(
                        cell, weights=np.repeat(values[at, k], p), minlength=p * bins)
                        for k in range(values.shape[1])])
                    if (i, node) in sums:
                        sums[i, node] += found
                    else:
                        sums[i, node] = found
        if sums:
            yield pd.DataFrame({"unit": [k[0] for k in sums], "node": [k[1] for k in sums],
                                "sums": [v.tobytes() for v in sums.values()]})

    def choose(at: tuple, flat: np.ndarray, width: int) -> dict:
        cube = flat.reshape(width, p, bins)
        totals = cube[:, 0].sum(axis=1)
        low = np.cumsum(cube, axis=2)[:, :, :-1]
        high = totals[:, None, None] - low
        usable = (low[-1] > 0) & (high[-1] > 0)
        for j, e in enumerate(edges):
            usable[j, len(e):] = False
        sides = [(s[1:-2] ** 2).sum(axis=0) / np.maximum(s[0], 1e-300) for s in (low, high)]
        found = np.where(usable, sides[0] + sides[1], -np.inf)
        _, unit, _, nodes, keys = asked.value[at[0]]
        may = allowed_features(keys[[nodes.index(at[1])]], p, rules)
        limited = found if may is None else np.where(may[0][:, None], found, -np.inf)
        if not np.isfinite(limited).any():
            limited = found
        best = -np.inf
        pick = (-1, 0)
        for j in range(p):
            k = int(np.argmax(limited[j])) if limited.shape[1] else 0
            if limited.shape[1] and limited[j, k] > best * (1 + 1e-12) + 1e-300:
                best, pick = limited[j, k], (j, k)
        j, k = pick
        sides = [s[:, j, k] if j >= 0 else totals for s in (low, high)]
        threshold = 0.0
        if j >= 0:
            threshold = float(edges[j][k])
            if known[j] is not None:  # the middle of the values on both sides
                there = np.flatnonzero(cube[-1, j, :len(known[j])] > 0)
                threshold = float(between(known[j][there[there <= k][-1]],
                                          known[j][there[there > k][0]]))
        return {"unit": at[0], "node": at[1], "feature": j, "threshold": threshold,
                "gain": max(0.0, float(best - (totals[1:-2] ** 2).sum() / max(totals[0], 1e-300)))
                if j >= 0 else 0.0, "low": sides[0].tolist(), "high": sides[1].tolist()}

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, flat, out = None, None, []
        for batch in batches:
            for unit, node, packed in zip(batch["unit"], batch["node"], batch["sums"]):
                if (unit, node) != at:
                    if at is not None:
                        out.append(choose(at, flat, len(flat) // (p * bins)))
                    at, flat = (unit, node), np.zeros(len(packed) // 8)
                flat = flat + np.frombuffer(packed)
        if at is not None:
            out.append(choose(at, flat, len(flat) // (p * bins)))
        if out:
            yield pd.DataFrame(out)

    sent = table.frame.mapInPandas(histograms, "unit long, node long, sums binary")
    return sent.repartition("unit", "node").sortWithinPartitions("unit", "node").mapInPandas(
        merge, "unit long, node long, feature long, threshold double, gain double,"
               " low array<double>, high array<double>").toPandas()


def _roots(table: Table, units: list[Unit], stats: Stats, rules: Rules) -> list[Growing]:
    """Trees of one node, with its totals from one pass."""
    inputs = table.inputs
    shared = table.frame.sparkSession.sparkContext.broadcast(units)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = None
        for batch in batches:
            rows = Rows.of(batch, inputs)
            parts = []
            for unit in shared.value:
                values = stats(rows, unit)
                parts.append([*values.sum(axis=0), (values[:, 0] > 0).sum()])
            found = np.array(parts) if found is None else found + np.array(parts)
        if found is not None:
            yield pd.DataFrame({"unit": np.arange(len(found)), "totals": found.tolist()})

    sent = table.frame.mapInPandas(sums, "unit long, totals array<double>")
    added = sent.select("unit", F.posexplode("totals")).groupBy("unit", "pos").agg(
        F.sum("col").alias("total")).toPandas().sort_values(["unit", "pos"])
    out = []
    for unit, part in added.groupby("unit"):
        growing = Growing(units[int(unit)], rules)
        totals = part["total"].to_numpy()
        growing.add(totals[:-1], units[int(unit)].key, 0, totals[-1])
        out.append(growing)
    return out


def grow_upper(table: Table, units: list[Unit], stats: Stats, rules: Rules,
               small_enough: int) -> list[Growing]:
    """Grow trees over the whole table until every open node has few enough rows.

    The driver holds the nodes of these upper levels, about the number of rows over
    ``small_enough`` for each tree.
    """
    growing = _roots(table, units, stats, rules)
    bins = max((len(e) for e in table.find_edges()), default=0) + 1
    while True:
        asked = []
        for g in growing:
            nodes = [k for k in g.open_leaves() if g.n_rows[k] > small_enough]
            if nodes:
                asked.append((g, nodes))
        if not asked:
            return growing
        width = len(asked[0][0].totals[0]) + 1
        per_node = bins * len(table.inputs) * width
        for group in _shares(asked, max(1, HISTOGRAM_CELLS // per_node)):
            for cut in _level(table, group, stats).itertuples(index=False):
                g = group[cut.unit][0]
                if cut.feature < 0:  # rows of equal values
                    g.closed.add(cut.node)
                    continue
                keys = np.array([g.key[cut.node]], np.uint64)
                g.feature[cut.node], g.threshold[cut.node] = cut.feature, cut.threshold
                g.gain[cut.node], g.left[cut.node] = cut.gain, len(g.feature)
                for side, totals in enumerate((cut.low, cut.high)):
                    g.add(np.array(totals[:-1]), int(child_keys(keys, side)[0]),
                          g.depth[cut.node] + 1, totals[-1])


def _shares(asked, n_nodes: int):
    """The asked-for nodes in groups of so many."""
    group, size = [], 0
    for g, nodes in asked:
        for first in range(0, len(nodes), n_nodes):
            part = nodes[first:first + n_nodes]
            if group and size + len(part) > n_nodes:
                yield group
                group, size = [], 0
            group.append((g, part))
            size += len(part)
    if group:
        yield group


def _finished(table: Table, growing: list[Growing], stats: Stats, scored: dict[int, frozenset]
              ) -> DataFrame:
    """Finish open leaves in the tasks that get their rows.

    Gives ``unit, node, tree`` (the grown subtree, packed) once for every open leaf, and
    ``unit, row, value`` for rows of the scored parts of its fit.
    """
    inputs, rules = table.inputs, growing[0].rules
    shared = table.frame.sparkSession.sparkContext.broadcast(
        [(g.unit, g.tree(), g.open_leaves(), g.key, g.depth) for g in growing])
    width = len(growing[0].totals[0])
    values = [f"_s{k}" for k in range(width)]
    schema = ", ".join(["unit long", "node long", "row long", "wanted boolean",
                        *[f"{c} double" for c in [*inputs, *values]]])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = Rows.of(batch, inputs)
            for i, (unit, tree, leaves, _, _) in enumerate(shared.value):
                found = stats(rows, unit)
                wanted = np.isin(rows.part, list(scored.get(unit.fit, ())))
                node = tree.leaves(rows.x)
                at = np.flatnonzero(wanted | ((found[:, 0] > 0) & np.isin(node, leaves)))
                out = pd.DataFrame({"unit": i, "node": node[at], "row": rows.row[at].view(np.int64),
                                    "wanted": wanted[at]})
                out[inputs], out[values] = rows.x[at], found[at]
                yield out

    def finish(key, part: pd.DataFrame) -> pd.DataFrame:
        i, node = int(key[0]), int(key[1])
        unit, tree, leaves, keys, depths = shared.value[i]
        x = part[inputs].to_numpy(float)
        if node in leaves:
            found = part[values].to_numpy(float)
            # In one order, whatever the shuffle, so that sums come out the same.
            order = np.lexsort([part["row"].to_numpy(), *x.T[::-1]])
            grown = grow(x[order], found[order], rules, keys[node], depths[node])
        else:
            grown = Tree(*(a[node:node + 1] for a in (
                tree.feature, tree.threshold, tree.left, tree.value, tree.gain, tree.weight)))
        wanted = part["wanted"].to_numpy(bool)
        means = grown.predict(x[wanted])
        rows = pd.DataFrame({"unit": i, "node": node, "row": part["row"][wanted].to_numpy(),
                             "value": list(means), "tree": None})
        packed = pd.DataFrame({"unit": [i], "node": [node], "row": [None], "value": [None],
                               "tree": [grown.packed()]})
        return (pd.concat([rows, packed]) if node in leaves else rows).astype({"row": "Int64"})

    return table.frame.mapInPandas(route, schema).groupBy("unit", "node").applyInPandas(
        finish, "unit long, node long, row long, value array<double>, tree binary")


def _graft(growing: Growing, subtrees: dict[int, Tree]) -> Tree:
    """The upper levels with the finished subtrees in place of their leaves."""
    base = growing.tree()
    parts, n = [base], len(base.feature)
    for node, sub in subtrees.items():
        for name in ("feature", "threshold", "gain", "value"):
            getattr(base, name)[node] = getattr(sub, name)[0]
        # The root of the subtree is the leaf itself; the others move behind what is there.
        base.left[node] = n + sub.left[0] - 1
        parts.append(Tree(sub.feature[1:], sub.threshold[1:], sub.left[1:] + n - 1, sub.value[1:],
                          sub.gain[1:], sub.weight[1:]))
        n += len(sub.feature) - 1
    return Tree(*(np.concatenate([getattr(t, name) for t in parts]) for name in (
        "feature", "threshold", "left", "value", "gain", "weight")))


# -- fitted models --------------------------------------------------------------------


@dataclass
class GrownModel:
    """The trees of a fitted model and how their values make a prediction.

    Forests and single trees average; boosting (``step`` > 0) adds to ``start`` and, for
    classes, turns the sums into probabilities. ``outputs`` trees belong to a round.
    The driver holds all nodes, as MLlib does; limit ``depth`` where that is too much.
    """

    inputs: list[str]
    classes: int
    trees: list[Tree]
    start: list[float]
    step: float = 0.0
    outputs: int = 1

    def raw(self, x: np.ndarray) -> np.ndarray:
        if not self.step:
            return sum(t.predict(x) for t in self.trees) / len(self.trees) + self.start[0]
        out = np.tile(np.array(self.start), (len(x), 1))
        for i, tree in enumerate(self.trees):
            out[:, i % self.outputs] += self.step * tree.predict(x)[:, 0]
        return _probabilities(out) if self.classes else out

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` and, for classes, ``_probability``."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def apply(*columns: pd.Series) -> pd.Series:
            x = np.stack([c.to_numpy(float) for c in columns], axis=1)
            return pd.Series(list(shared.value.raw(x)) if len(x) else [], dtype=object)

        raw = df.withColumn("_raw", apply(*self.inputs))
        if not self.classes:
            return raw.withColumn("prediction", F.col("_raw")[0]).drop("_raw")
        best = F.array_position("_raw", F.array_max("_raw")) - 1
        return raw.withColumn("prediction", best.cast("double")).withColumnRenamed(
            "_raw", "_probability")

    def importances(self) -> np.ndarray:
        """Mean share of each feature in what the cuts of a tree explain."""
        found = sum(t.importances(len(self.inputs)) for t in self.trees)
        return found / found.sum() if found.sum() > 0 else found

    def nodes(self) -> pd.DataFrame:
        return pd.concat([pd.DataFrame({
            "tree": i, "node": np.arange(len(t.feature)), "feature": t.feature,
            "threshold": t.threshold, "left": t.left, "value": t.value.tolist(), "gain": t.gain,
            "weight": t.weight}) for i, t in enumerate(self.trees)], ignore_index=True)

    @staticmethod
    def trees_of(nodes: pd.DataFrame) -> list[Tree]:
        nodes = nodes.sort_values(["tree", "node"])
        return [Tree(part["feature"].to_numpy(np.int32), part["threshold"].to_numpy(float),
                     part["left"].to_numpy(np.int64), np.stack(part["value"].to_numpy()),
                     part["gain"].to_numpy(float), part["weight"].to_numpy(float))
                for _, part in nodes.groupby("tree")]


NODES = ("tree long, node long, feature int, threshold double, left long, value array<double>,"
         " gain double, weight double")


def _probabilities(margins: np.ndarray) -> np.ndarray:
    if margins.shape[1] == 1:
        p = 1 / (1 + np.exp(-np.clip(margins[:, 0], -500, 500)))
        return np.stack([1 - p, p], axis=1)
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


# -- forests --------------------------------------------------------------------------


def _tree_stats(table: Table) -> Stats:
    return lambda rows, unit: table.stats(rows.y, rows.weights(unit))


def _without_frame(table: Table) -> Table:
    """What tasks need of the table: all but the Spark objects."""
    return Table(None, table.inputs, table.classes, table.n, table.middle)


def _units(fits: dict[int, frozenset], trees: int, bootstrap: bool, seed: int) -> list[Unit]:
    return [Unit(fit, t, parts, seed * 100_003 + t if bootstrap else None)
            for fit, parts in fits.items() for t in range(trees)]


def grow_forest(table: Table, parts: frozenset, trees: int = 1, rules: Rules = Rules(),
                bootstrap: bool = False, seed: int = 42) -> GrownModel:
    """The trees of one fit, from the rows of ``parts``."""
    units = _units({0: parts}, trees, bootstrap, seed)
    light = _without_frame(table)
    stats = _tree_stats(light)
    if table.shared is not None:
        shared, spark = table.shared, table.frame.sparkSession

        def tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows, groups = shared.value
            for batch in batches:
                for i in batch["id"]:
                    w = rows.group_weights(units[i])
                    tree = grow(groups.x, light.stats(groups.y, w), rules, units[i].key)
                    yield pd.DataFrame({"id": [i], "tree": [tree.packed()]})

        dealt = spark.range(0, len(units), 1, min(len(units), 1_000))
        found = dealt.mapInPandas(tasks, "id long, tree binary").collect()
        grown = [Tree.unpacked(r["tree"]) for r in sorted(found, key=lambda r: r["id"])]
    else:
        growing = grow_upper(table, units, stats, rules, table.task_rows())
        subtrees: dict[int, dict[int, Tree]] = {i: {} for i in range(len(units))}
        for r in _finished(table, growing, stats, {}).filter("tree IS NOT NULL").collect():
            subtrees[r["unit"]][r["node"]] = Tree.unpacked(r["tree"])
        grown = [_graft(g, subtrees[i]) for i, g in enumerate(growing)]
    return GrownModel(table.inputs, table.classes, grown, [table.middle])


def forest_scores(table: Table, fits: dict[int, tuple[frozenset, frozenset]], trees: int = 1,
                  rules: Rules = Rules(), bootstrap: bool = False, seed: int = 42
                  ) -> dict[int, float]:
    """Accuracy or R2 of several fits, each given by its parts to learn from and to score.

    The fits share the table and, where it is small, one job.
    """
    units = _units({k: v[0] for k, v in fits.items()}, trees, bootstrap, seed)
    light = _without_frame(table)
    scored = {k: v[1] for k, v in fits.items()}
    if table.shared is None:
        return _large_scores(table, units, scored, rules, light, trees)
    shared, spark = table.shared, table.frame.sparkSession
    chunks = [units[first + i:first + min(i + TREES_PER_TASK, trees)]
              for first in range(0, len(units), trees) for i in range(0, trees, TREES_PER_TASK)]

    def tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, groups = shared.value
        for batch in batches:
            for i in batch["id"]:
                total = 0.0
                for unit in chunks[i]:
                    stats = light.stats(groups.y, rows.group_weights(unit))
                    total = total + grow(groups.x, stats, rules, unit.key).predict(groups.x)
                yield pd.DataFrame({"fit": [chunks[i][0].fit], "chunk": [i],
                                    "sums": [total.tobytes()]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, groups = shared.value
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for fit, sums in zip(batch["fit"], batch["sums"]):
                totals[fit] = totals.get(fit, 0.0) + np.frombuffer(sums)
        for fit, total in totals.items():
            means = total.reshape(len(groups.x), -1) / trees + light.middle
            w = rows.group_weights(Unit(fit, 0, scored[fit]))
            yield pd.DataFrame({"fit": [fit], "score": [weighted_score(means, groups.y, w, light.classes)]})

    dealt = spark.range(0, len(chunks), 1, min(len(chunks), 1_000))
    sums = dealt.mapInPandas(tasks, "fit long, chunk long, sums binary")
    merged = sums.repartition("fit").sortWithinPartitions("fit", "chunk").mapInPandas(
        merge, "fit long, score double")
    return {r["fit"]: r["score"] for r in merged.collect()}


def weighted_score(means: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int) -> float | None:
    """Accuracy of the largest share, or R2 of the mean, over weighted rows."""
    if not w.sum():
        return None
    if classes:
        return float(w[means.argmax(axis=1) == y].sum() / w.sum())
    wrong = (w * (y - means[:, 0]) ** 2).sum()
    spread = (w * (y - (w * y).sum() / w.sum()) ** 2).sum()
    return float(1 - wrong / spread) if spread > 0 else float(wrong == 0)


def _large_scores(table: Table, units: list[Unit], scored, rules: Rules, light: Table, trees: int
                  ) -> dict[int, float]:
    """Scores where the table does not fit a task: fit by fit, predictions met by row."""
    stats, out = _tree_stats(light), {}
    for fit in scored:
        own = [u for u in units if u.fit == fit]
        growing = grow_upper(table, own, stats, rules, table.task_rows())
        values = _finished(table, growing, stats, scored).filter("tree IS NULL")
        summed = values.select("row", F.posexplode("value")).groupBy("row", "pos").agg(
            F.avg("col").alias("mean"))
        if light.classes:
            best = summed.groupBy("row").agg(F.max_by(
                "pos", F.struct("mean", -F.col("pos"))).alias("found"))
        else:
            best = summed.select("row", (F.col("mean") + light.middle).alias("found"))
        rows = table.frame.select(F.col("_hash").alias("row"), "label", "_count")
        out[fit] = frame_score(rows.join(best, "row"), light.classes)
    return out


def frame_score(pairs: DataFrame, classes: int) -> float | None:
    """As ``weighted_score``, of ``label, found, _count``."""
    w, y, found = F.col("_count"), F.col("label"), F.col("found")
    if classes:
        return pairs.agg(F.sum(F.when(y == found, w).otherwise(0)) / F.sum(w)).first()[0]
    middle = pairs.agg(F.sum(w * y) / F.sum(w)).first()[0]
    if middle is None:
        return None
    wrong, spread = pairs.agg(F.sum(w * (y - found) ** 2), F.sum(w * (y - middle) ** 2)).first()
    return 1 - wrong / spread if spread > 0 else float(wrong == 0)


# -- boosting -------------------------------------------------------------------------


@dataclass
class Boosting:
    """The rounds so far of one fit: squared loss, or logistic or softmax loss of classes."""

    classes: int
    start: np.ndarray
    step: float
    trees: list[list[Tree]] = field(default_factory=list)

    @property
    def outputs(self) -> int:
        return self.classes if self.classes > 2 else 1

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(self.start, (len(x), 1))
        for trees in self.trees:
            self.move(out, x, trees)
        return out

    def move(self, margins: np.ndarray, x: np.ndarray, trees: list[Tree]) -> None:
        for k, tree in enumerate(trees):
            margins[:, k] += self.step * tree.predict(x)[:, 0]

    def gradients(self, margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is left of the target for each output, and the curvature of the loss."""
        if not self.classes:
            return y[:, None] - margins, np.ones((len(y), 1))
        p = _probabilities(margins)
        if self.outputs == 1:
            return (y - p[:, 1])[:, None], (p[:, 0] * p[:, 1])[:, None]
        rest = -p
        rest[np.arange(len(y)), y.astype(int)] += 1
        k = self.classes
        return rest, np.abs(rest) * (1 - np.abs(rest)) * k / (k - 1)


def first_margins(counts: np.ndarray, middle: float, classes: int) -> np.ndarray:
    if not classes:
        return np.array([middle])
    shares = np.maximum(counts / max(counts.sum(), 1), 1e-12)
    if classes <= 2:
        shares = np.append(shares, [1e-12])[:2]
        return np.array([math.log(shares[1] / shares[0])])
    return np.log(shares)


def _boost_task(groups: Rows, w: np.ndarray, classes: int, rounds: int, rules: Rules, step: float
                ) -> Boosting:
    kept = w > 0
    x, y, w = groups.x[kept], groups.y[kept], w[kept]
    counts = np.bincount(y.astype(int), weights=w, minlength=classes) if classes else w
    start = first_margins(counts, (w * y).sum() / max(w.sum(), 1e-300), classes)
    state = Boosting(classes, start, step)
    margins = state.margins(x)
    for _ in range(rounds):
        rest, curve = state.gradients(margins, y)
        trees = []
        for k in range(state.outputs):
            tree = grow(x, np.stack([w, w * rest[:, k], w * rest[:, k] ** 2], axis=1), rules, k + 1)
            leaf, m = tree.leaves(x), len(tree.feature)
            above = np.bincount(leaf, weights=w * rest[:, k], minlength=m)
            below = np.bincount(leaf, weights=w * curve[:, k], minlength=m)
            tree.value = _leaf_values(above, below)
            trees.append(tree)
        state.move(margins, x, trees)
        state.trees.append(trees)
    return state


def _leaf_values(above: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.where(below > 1e-150, above / np.maximum(below, 1e-150), 0.0)[:, None]


def _boost_large(table: Table, fits: dict[int, frozenset], rounds: int, rules: Rules, step: float
                 ) -> dict[int, Boosting]:
    """Boost all fits together: each pass sums the histograms of all their outputs."""
    light, frame = _without_frame(table), table.frame
    spark, classes = frame.sparkSession, table.classes
    target = F.col("label").cast("int") if classes else F.lit(0)
    by_part = frame.groupBy("_part", target.alias("c")).agg(
        F.sum("_count").alias("n"), F.sum(F.col("_count") * F.col("label")).alias("s")).collect()
    states = {}
    for fit, parts in fits.items():
        own = [r for r in by_part if r["_part"] in parts]
        counts = np.zeros(max(classes, 1))
        for r in own:
            counts[r["c"]] += r["n"]
        middle = sum(r["s"] for r in own) / max(counts.sum(), 1)
        states[fit] = Boosting(classes, first_margins(counts, middle, classes), step)
    units = [Unit(fit, k, parts) for fit, parts in fits.items()
             for k in range(states[fit].outputs)]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(states)

        def left(rows: Rows, unit: Unit, shared=shared):
            # Units of a fit come one after the other and share its margins.
            known = getattr(rows, "left", None)
            if known is None or known[0] != unit.fit:
                state = shared.value[unit.fit]
                rows.left = known = (unit.fit, *state.gradients(state.margins(rows.x), rows.y))
            return known[1][:, unit.tree], known[2][:, unit.tree]

        def stats(rows: Rows, unit: Unit, left=left) -> np.ndarray:
            w, (rest, _) = rows.weights(unit), left(rows, unit)
            return np.stack([w, w * rest, w * rest**2], axis=1)

        growing = grow_upper(table, units, stats, rules, 0)
        trees = [g.tree() for g in growing]
        grown = spark.sparkContext.broadcast(trees)

        def leaf_sums(batches, left=left, grown=grown) -> Iterator[pd.DataFrame]:
            found = [np.zeros((2, len(t.feature))) for t in grown.value]
            for batch in batches:
                rows = Rows.of(batch, light.inputs)
                for i, unit in enumerate(units):
                    w, sides = rows.weights(unit), left(rows, unit)
                    leaf = grown.value[i].leaves(rows.x)
                    for k, side in enumerate(sides):
                        found[i][k] += np.bincount(leaf, weights=w * side,
                                                   minlength=found[i].shape[1])
            yield pd.DataFrame({"unit": range(len(found)), "sums": [f.ravel() for f in found]})

        sent = frame.mapInPandas(leaf_sums, "unit long, sums array<double>")
        added = sent.select("unit", F.posexplode("sums")).groupBy("unit", "pos").agg(
            F.sum("col").alias("total")).toPandas().sort_values(["unit", "pos"])
        for i, part in added.groupby("unit"):
            above, below = part["total"].to_numpy().reshape(2, -1)
            trees[i].value = _leaf_values(above, below)
        for fit, state in states.items():
            state.trees.append([t for t, u in zip(trees, units) if u.fit == fit])
    return states


def boost(table: Table, fits: dict[int, tuple[frozenset, frozenset | None]], rounds: int,
          rules: Rules, step: float) -> tuple[dict[int, GrownModel], dict[int, float]]:
    """Boost several fits at once: the models of those without parts to score, scores of the rest."""
    light = _without_frame(table)
    if table.shared is None:
        states = _boost_large(table, {k: v[0] for k, v in fits.items()}, rounds, rules, step)
        models = {k: _as_model(light, s) for k, s in states.items()}
        scores = {}
        for k, (_, scored) in fits.items():
            if scored is not None:
                rows = table.frame.filter(F.col("_part").isin([*scored]))
                found = models[k].transform(rows).withColumn("found", F.col("prediction"))
                scores[k] = frame_score(found, light.classes)
        return {k: m for k, m in models.items() if fits[k][1] is None}, scores
    shared, spark = table.shared, table.frame.sparkSession

    def tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, groups = shared.value
        for batch in batches:
            for i in batch["id"]:
                learn, scored = fits[i]
                w = rows.group_weights(Unit(i, 0, learn))
                model = _as_model(light, _boost_task(groups, w, light.classes, rounds, rules, step))
                score = None
                if scored is not None:
                    score = weighted_score(model.raw(groups.x), groups.y,
                                   rows.group_weights(Unit(i, 0, scored)), light.classes)
                grown = None
                if scored is None:
                    grown = pickle.dumps((model.start, [t.packed() for t in model.trees]))
                yield pd.DataFrame({"id": [i], "score": [score], "model": [grown]})

    names = sorted(fits)
    dealt = spark.createDataFrame([(i,) for i in names], "id long").repartition(len(names), "id")
    found = dealt.mapInPandas(tasks, "id long, score double, model binary").collect()
    models = {}
    for r in found:
        if r["model"] is not None:
            start, packed = pickle.loads(r["model"])
            models[r["id"]] = GrownModel(
                table.inputs, table.classes, [Tree.unpacked(t) for t in packed], start, step,
                max(1, len(packed) // max(1, rounds)))
    return models, {r["id"]: r["score"] for r in found if r["model"] is None}


def _as_model(light: Table, state: Boosting) -> GrownModel:
    trees = [t for group in state.trees for t in group]
    return GrownModel(light.inputs, light.classes, trees, state.start.tolist(), state.step,
                      state.outputs)
