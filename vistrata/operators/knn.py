"""Exact nearest neighbours as a partitioned join.

The training rows are divided into cells around pivots taken from the data, and crowded
cells again, level by level, until a cell fits a task; so the cells grow with the rows.
Every cell knows how far its rows lie from its pivot and the box that holds them.

A query first goes down to the cell of its nearest pivots and finds k rows there; the
k-th distance is its bound. With it the query goes down a second time, now into every
cell that may hold a nearer row: the box, the triangle inequality and the plane between
two pivots rule the others out. (The first two steps follow Lu, Shen, Chen and Ooi,
"Efficient processing of k nearest neighbor joins using MapReduce", VLDB 2012.)

On the way down, pivots and rows meet in a sorted stream, a level at a time, so neither
the driver nor a task holds all pivots. Cells with many queries are copied to blocks of
queries. Of equal vectors only the k smallest ids can be neighbours, so the others leave
first; equal queries are asked once.

Between many independent columns the bounds rule out little, and every query would go into
most cells. Some queries are asked first, after the first level and again in the last cells;
if to go into their cells costs more than to meet all rows, all queries meet all tiles,
large blocks of rows, instead. That is a matrix product in single precision whose candidates
are measured exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from vistrata.plans.session import materialise

# Rows of a cell that is not divided any more, and queries that meet a cell in one task.
CELL_ROWS, BLOCK_ROWS = 400, 4_000
# Rows of a tile, where bounds rule out little (and at most their bytes); a quarter as many
# queries meet it in one task, or fewer, so that there are some blocks of them.
TILE_ROWS, TILE_BYTES, LEAST_BLOCKS = 100_000, 64_000_000, 16
# Queries and rows whose products are made at once, and candidates for a query among them
# that are too many for single precision.
PANEL_QUERIES, PANEL_ROWS, MANY = 256, 2_048, 64
# Queries that tell how many cells a query goes into, and rows from which on they are asked;
# columns from which on they are asked after the first level, too, and rows they meet there.
PROBES, PROBED_ROWS = 500, 10_000
PROBED_COLUMNS, HOME_ROWS = 8, 5_000
# Rows of a tile that cost a query as much as going into a cell.
VISIT_ROWS = 10_000
# Pivots drawn in a cell. The root is cell 0, others are named by a hash of their path.
FANOUT = 256
# Rows of a cell that one task sends down a level.
STREAM_ROWS = 10_000
DISTANCE_DIGITS = 9
# Candidates whose distances are measured at once.
CANDIDATES = 20_000
# Room for rounding in the bounds, relative and absolute.
_SLACK = 1e-9


def _vectors(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _pivot_distances(x: np.ndarray, pivots: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    if metric == "chebyshev":
        # A column at a time: no array of all columns of all pairs.
        out = np.abs(x[:, :1] - pivots[:, 0])
        for i in range(1, x.shape[1]):
            np.maximum(out, np.abs(x[:, i:i + 1] - pivots[:, i]), out=out)
        return out
    middle = pivots.mean(axis=0)
    a, b = x - middle, pivots - middle
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


# -- cells ----------------------------------------------------------------------------

CHILDREN = ("parent long, cell long, pivot array<double>, n long, radius double,"
            " low array<double>, high array<double>")


def _meet(rows: DataFrame, children: DataFrame, most: int, schema: str, step) -> DataFrame:
    """What ``step(rows, children)`` yields for the rows of each cell and its children.

    Rows whose cell has no children are left out. A cell with many rows (``most`` is the
    largest number) is dealt over tasks, each with a copy of its children.
    """
    salts = max(1, -(-most // STREAM_ROWS))
    names = ["cell", "pivot", "radius", "low", "high"]

    def nothing(kind: str) -> Column:
        # No NULLs among numbers: pandas would make them doubles.
        return F.lit(None if kind.startswith("array") else 0).cast(kind)

    left = rows.withColumns({
        "_at": F.col("cell"), "_salt": F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int"),
        "_kind": F.lit(1), **{f"_{c}": nothing(dict(children.dtypes)[c]) for c in names}})
    right = children.select(
        *[nothing(t).alias(c) for c, t in rows.dtypes], F.col("parent").alias("_at"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), F.lit(0).alias("_kind"),
        *[F.col(c).alias(f"_{c}") for c in names])
    both = left.unionByName(right).repartition("_at", "_salt").sortWithinPartitions(
        "_at", "_salt", "_kind", "_cell")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, known, held = None, None, []
        for batch in batches:
            for key, part in batch.groupby(["_at", "_salt"], sort=True):
                if key != at:
                    at, known, held = key, None, []
                pivots = part[part["_kind"] == 0]
                if len(pivots):
                    held.append(pivots)
                found = part[part["_kind"] == 1]
                if len(found) and held:
                    if known is None:
                        known = pd.concat(held)
                    yield from step(found, known)

    return both.mapInPandas(stream, schema)


def _to_nearest(schema: str, metric: str):
    """Rows move to the child whose pivot is nearest."""
    names = [part.split()[0] for part in schema.split(", ")]

    def step(rows: pd.DataFrame, children: pd.DataFrame) -> Iterator[pd.DataFrame]:
        distances = _pivot_distances(
            _vectors(rows["vec"]), _vectors(children["_pivot"]), metric)
        nearest = distances.argmin(axis=1)
        yield rows.assign(
            cell=children["_cell"].to_numpy()[nearest].astype(np.int64),
            to_pivot=distances[np.arange(len(rows)), nearest])[names]

    return step


def _reduced(cells: np.ndarray, n: np.ndarray, radius: np.ndarray, low: np.ndarray,
             high: np.ndarray) -> pd.DataFrame:
    """One row per cell, in the order of the cells."""
    order = np.argsort(cells, kind="stable")
    named = cells[order]
    first = np.flatnonzero(np.concatenate(([True], named[1:] != named[:-1])))
    return pd.DataFrame({
        "cell": named[first], "n": np.add.reduceat(n[order], first),
        "radius": np.maximum.reduceat(radius[order], first),
        "low": list(np.minimum.reduceat(low[order], first)),
        "high": list(np.maximum.reduceat(high[order], first))})


def _summaries(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """``CHILDREN`` of the cells of ``rows``: number, distance from the pivot, box."""
    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = _vectors(batch["vec"])
                yield _reduced(batch["cell"].to_numpy(), np.ones(len(x), np.int64),
                               batch["to_pivot"].to_numpy(), x, x)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Cells are many and small: a sorted stream, in which the last one may go on.
        held = None
        for batch in batches:
            if not len(batch):
                continue
            part = batch if held is None else pd.concat([held, batch])
            found = _reduced(part["cell"].to_numpy(), part["n"].to_numpy(),
                             part["radius"].to_numpy(), _vectors(part["low"]),
                             _vectors(part["high"]))
            held = found.iloc[-1:]
            if len(found) > 1:
                yield found.iloc[:-1]
        if held is not None:
            yield held

    schema = "cell long, n long, radius double, low array<double>, high array<double>"
    found = rows.mapInPandas(gather, schema).repartition("cell").sortWithinPartitions(
        "cell").mapInPandas(merge, schema)
    return pivots.join(found, "cell").select(
        "parent", "cell", "pivot", "n", "radius", "low", "high")


def _choose_pivots(rows: DataFrame, parents: DataFrame, wanted: int | None = None) -> DataFrame:
    """``parent, cell, pivot``: vectors with small hashes become the pivots of crowded cells.

    Those nearest to and farthest from the last pivot do, too, so every cell of unequal
    rows is divided.
    """
    n = F.col("n") / F.lit(CELL_ROWS / 4)
    want = F.lit(wanted) if wanted else F.least(F.lit(FANOUT), F.greatest(F.lit(2), F.ceil(n)))
    unlike = rows.groupBy("cell").agg(F.approx_count_distinct("vec").alias("unlike"))
    named = parents.join(unlike, "cell").select("cell", "unlike", want.cast("int").alias("want"))
    draw = F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # A few more than wanted are kept by their hash alone, before the window.
    likely = rows.join(named, "cell").withColumn("draw", draw).filter(
        F.col("draw") * F.col("unlike") <= 2 * F.col("want") + 20).select(
        "cell", "vec", "draw", "want").distinct()
    place = F.row_number().over(Window.partitionBy("cell").orderBy("draw", "vec"))
    drawn = likely.withColumn("place", place).filter("place <= want").select("cell", "vec")
    if not wanted:
        place = F.struct("to_pivot", "key")
        ends = rows.join(named, "cell").groupBy("cell").agg(F.array(
            F.min_by("vec", place), F.max_by("vec", place)).alias("vecs"))
        drawn = drawn.unionByName(ends.select("cell", F.explode("vecs").alias("vec")))
    chosen = drawn.select(F.col("cell").alias("parent"), F.col("vec").alias("pivot"))
    number = F.row_number().over(Window.partitionBy("parent").orderBy("pivot"))
    return chosen.distinct().withColumn(
        "cell", F.xxhash64("parent", number)).select("parent", "cell", "pivot")


def _next_level(rows: DataFrame, parents: DataFrame, most: int, pivots: int | None, metric: str
                ) -> tuple[DataFrame, DataFrame]:
    """The rows of crowded cells in their next cells, and these cells."""
    schema = "key long, vec array<double>, label double, part long, cell long, to_pivot double"
    chosen = materialise(_choose_pivots(rows, parents, pivots), "knn-pivots")
    children = chosen.withColumns({
        "n": F.lit(0).cast("long"), "radius": F.lit(0.0),
        "low": F.lit(None).cast("array<double>"), "high": F.lit(None).cast("array<double>")})
    crowded = rows.join(parents.select("cell"), "cell", "left_semi")
    moved = materialise(_meet(
        crowded.select(*[c.split()[0] for c in schema.split(", ")]), children, most, schema,
        _to_nearest(schema, metric)), "knn-cells")
    return moved, materialise(_summaries(moved, chosen), "knn-children")


def _first_level(train: DataFrame, pivots: int | None, metric: str) -> tuple[DataFrame, DataFrame]:
    rows = train.withColumn("to_pivot", F.lit(0.0))
    parents = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    most = parents.agg(F.max("n")).first()[0]
    return _next_level(rows, parents, most, pivots, metric)


def _divide(train: DataFrame, pivots: int | None, metric: str,
            begun: tuple[DataFrame, DataFrame] | None = None
            ) -> tuple[DataFrame, list[DataFrame]]:
    """The training rows with their last cell, and the children of each level."""
    moved, cells = begun or _first_level(train, pivots, metric)
    done, levels = [], [cells]
    while True:
        # Cells of equal vectors stay as they are; they have k rows for each part at most.
        apart = F.exists(F.arrays_zip("low", "high"), lambda z: z["low"] < z["high"])
        parents = cells.filter((F.col("n") > CELL_ROWS) & apart).select("cell", "n")
        most = parents.agg(F.max("n")).first()[0]
        if most is None:
            done.append(moved)
            break
        done.append(moved.join(parents.select("cell"), "cell", "left_anti"))
        moved, cells = _next_level(moved, parents, most, None, metric)
        levels.append(cells)
    leaves = done[0]
    for part in done[1:]:
        leaves = leaves.unionByName(part)
    return materialise(leaves, "knn-train"), levels


# -- queries --------------------------------------------------------------------------

QUERY = "key long, vec array<double>, part long, home long, bound double, cell long"


def _down_home(queries: DataFrame, levels: list[DataFrame], metric: str) -> DataFrame:
    """Queries at the last cell on the way to the nearest pivots."""
    schema = "key long, vec array<double>, part long, cell long, to_pivot double"
    rows = queries.withColumn("to_pivot", F.lit(0.0))
    stopped = []
    for i, cells in enumerate(levels):
        most = rows.groupBy("cell").count().agg(F.max("count")).first()[0] or 0
        moved = materialise(_meet(
            rows, cells, most, schema, _to_nearest(schema, metric)), "knn-home")
        if i + 1 == len(levels):
            stopped.append(moved)
            break
        inner = levels[i + 1].select(F.col("parent").alias("cell")).distinct()
        stopped.append(moved.join(inner, "cell", "left_anti"))
        rows = moved.join(inner, "cell", "left_semi")
    out = stopped[0]
    for part in stopped[1:]:
        out = out.unionByName(part)
    return out.drop("to_pivot")


def _may_hold(metric: str, slack: float):
    """Queries with every child that may hold a row within their bound."""
    names = [p.split()[0] for p in QUERY.split(", ")]

    def step(queries: pd.DataFrame, children: pd.DataFrame) -> Iterator[pd.DataFrame]:
        q, pivots = _vectors(queries["vec"]), _vectors(children["_pivot"])
        low, high = _vectors(children["_low"]), _vectors(children["_high"])
        radius, cells = children["_radius"].to_numpy(float), children["_cell"].to_numpy()
        between = _pivot_distances(pivots, pivots, metric)
        size = max(1, 2_000_000 // (len(pivots) * q.shape[1]))
        for first in range(0, len(q), size):
            part, x = queries.iloc[first:first + size], q[first:first + size]
            distances = _pivot_distances(x, pivots, metric)
            if metric == "chebyshev":
                least = np.zeros(distances.shape)
                for i in range(x.shape[1]):
                    np.maximum(least, low[:, i] - x[:, i:i + 1], out=least)
                    np.maximum(least, x[:, i:i + 1] - high[:, i], out=least)
            else:
                gaps = np.maximum(
                    np.maximum(low[None] - x[:, None], x[:, None] - high[None]), 0.0)
                least = np.sqrt((gaps * gaps).sum(axis=2))
                # Rows of a cell are nearer to its pivot than to the query's nearest pivot.
                near = distances.argmin(axis=1)
                own = distances[np.arange(len(x)), near][:, None]
                plane = (distances**2 - own**2) / (2 * np.maximum(between[near], 1e-300))
                least = np.where(between[near] > 0, np.maximum(least, plane), least)
            least = np.maximum(least, distances - radius)
            bound = part["bound"].to_numpy(float)[:, None]
            room = np.where(np.isfinite(bound), bound, 0.0) + distances.max(axis=1)[:, None]
            row, child = np.nonzero(least <= bound + room * slack + slack)
            # Piece by piece: a query may go into every child, a copy of its vector each time.
            yield part.iloc[row].assign(cell=cells[child].astype(np.int64))[names]

    return step


def _down_within(bounded: DataFrame, levels: list[DataFrame], metric: str, slack: float
                 ) -> DataFrame:
    """A row for each query and last cell, other than its own, within the query's bound."""
    rows, stopped = bounded, []
    for i, cells in enumerate(levels):
        most = rows.groupBy("cell").count().agg(F.max("count")).first()[0] or 0
        moved = materialise(_meet(
            rows, cells, most, QUERY, _may_hold(metric, slack)), "knn-routed")
        if i + 1 == len(levels):
            stopped.append(moved)
            break
        inner = levels[i + 1].select(F.col("parent").alias("cell")).distinct()
        stopped.append(moved.join(inner, "cell", "left_anti"))
        rows = moved.join(inner, "cell", "left_semi")
    out = stopped[0]
    for part in stopped[1:]:
        out = out.unionByName(part)
    return out.filter("cell <> home")


def _search_block(k: int, metric: str, digits: int | None):
    """The k nearest rows of one training block for each query of one query block."""

    def search(train: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, ...]] = []
        if len(train) and len(queries):
            x, q = _vectors(train["vec"]), _vectors(queries["vec"])
            ids, labels = train["key"].to_numpy(), train["label"].to_numpy()
            parts, own = train["part"].to_numpy(), queries["part"].to_numpy()
            qids = queries["key"].to_numpy()
            middle = x.mean(axis=0)
            a, b = x - middle, q - middle
            xx, qq = (a * a).sum(1), (b * b).sum(1)
            for start in range(0, len(q), 500):
                part = slice(start, start + 500)
                if metric == "chebyshev":
                    rough = _pivot_distances(q[part], x, metric)
                else:
                    rough = qq[part, None] + xx[None, :] - 2.0 * b[part] @ a.T
                rough[parts[None, :] == own[part, None]] = np.inf
                # Rough distances choose candidates; those are measured exactly.
                kept = min(k, len(x))
                border = np.partition(rough, kept - 1, axis=1)[:, kept - 1]
                if metric == "euclidean":
                    border = border + (qq[part] + xx.max()) * 1e-9 + 1e-9
                asked, near = np.nonzero((rough <= border[:, None]) & np.isfinite(rough))
                # A share of the pairs at a time: with many ties all rows are candidates.
                ends = np.searchsorted(asked, np.arange(len(rough) + 1))
                step = max(1, CANDIDATES // max(1, int(np.diff(ends).max())))
                for first in range(0, len(rough), step):
                    some = slice(ends[first], ends[min(first + step, len(rough))])
                    i, j = asked[some], near[some]
                    gap = x[j] - q[start + i]
                    if metric == "chebyshev":
                        exact = np.abs(gap).max(axis=1)
                    else:
                        exact = np.sqrt((gap * gap).sum(1))
                    exact = exact if digits is None else np.round(exact, digits)
                    order = np.lexsort((ids[j], exact, i))
                    place = np.arange(len(i)) - np.searchsorted(i, i)
                    best = order[place < k]
                    found.append((qids[start + i[best]], ids[j[best]], labels[j[best]],
                                  exact[best]))
        columns = ["qid", "id", "label", "distance"]
        if not found:
            return pd.DataFrame(columns=columns)
        return pd.DataFrame({c: np.concatenate(part) for c, part in zip(columns, zip(*found))})

    return search


FOUND = "qid long, id long, label double, distance double"


def _some(queries: DataFrame) -> DataFrame:
    """Queries that tell how many cells a query goes into."""
    share = max(1, queries.count() // PROBES)
    return materialise(
        queries.filter(F.pmod(F.xxhash64("key"), F.lit(share)) == 0), "knn-probes")


def _bounded(first: DataFrame, at_home: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """``QUERY``: the k-th distance at home; without k rows there any distance may count."""
    bounds = first.groupBy(F.col("qid").alias("key")).agg(
        F.max("distance").alias("far"), F.count(F.lit(1)).alias("n"))
    return at_home.join(bounds, "key", "left").join(groups, "key").select(
        "key", "vec", "part", F.col("cell").alias("home"),
        F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(float("inf"))).alias("bound"),
        F.col("first_cell").alias("cell"))


def _many_cells(bounded: DataFrame, levels: list[DataFrame], n_rows: int, slack: float) -> bool:
    """Whether meeting all tiles costs a query less than the cells it goes into."""
    probes = _some(bounded)
    cells = _down_within(probes, levels, "euclidean", slack).count()
    return cells * VISIT_ROWS > n_rows * probes.count()


def _many_children(asked: DataFrame, begun: tuple[DataFrame, DataFrame], k: int, n_rows: int,
                   block_rows: int, search, slack: float) -> bool:
    """The same, foreseen from the first level: also true of queries that go into most of it."""
    moved, cells = begun
    probes = _some(asked)
    at_home = materialise(_down_home(probes, [cells], "euclidean"), "knn-queries")
    # The distance to some rows at home bounds the k-th, too.
    share = F.ceil(F.col("n") / F.lit(HOME_ROWS))
    rows = moved.join(cells.select("cell", share.alias("share")), "cell").filter(
        F.pmod(F.xxhash64("key"), F.col("share")) == 0).drop("share")
    groups = probes.select("key", F.col("cell").alias("first_cell"))
    first = materialise(_search(rows, at_home, block_rows, search), "knn-near")
    bounded = materialise(_bounded(first, at_home, groups, k), "knn-bounded")
    met = _down_within(bounded, [cells], "euclidean", slack).count()
    return met > min(n_rows / VISIT_ROWS, cells.count() / 2) * probes.count()


# They stand for missing keys and parts among numbers.
NO_KEY, NO_PART = 2**63 - 1, -2**63
PACKED = "at int, n int, keys binary, vecs binary, labels binary, parts binary"


def _packed(rows: DataFrame, shares: int) -> DataFrame:
    """The rows dealt into ``shares``, many to a row of ``PACKED``.

    Values that floats hold without loss are packed as floats.
    """
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, part in batch.groupby("at"):
                x = _vectors(part["vec"])
                with np.errstate(over="ignore"):
                    short = x.astype(np.float32)
                yield pd.DataFrame({
                    "at": [at], "n": [len(part)],
                    "keys": [part["key"].to_numpy(np.int64).tobytes()],
                    "vecs": [(short if (short == x).all() else x).tobytes()],
                    "labels": [part["label"].to_numpy(float).tobytes()],
                    "parts": [part["part"].to_numpy(np.int64).tobytes()]})

    dealt = F.pmod(F.xxhash64("key"), F.lit(shares)).cast("int")
    # Several tasks pack a share: each writes out all copies of what it packs.
    return rows.select(
        dealt.alias("at"), F.pmod(F.hash("key"), F.lit(4)).alias("salt"),
        F.coalesce("key", F.lit(NO_KEY)).alias("key"), "vec", "label",
        F.coalesce("part", F.lit(NO_PART)).alias("part")).repartition(
        4 * shares, "at", "salt").mapInPandas(pack, PACKED)


def _unpacked(n: int, keys: bytes, vecs: bytes, labels: bytes, parts: bytes, columns: int
              ) -> tuple[np.ndarray, ...]:
    """Keys, vectors, labels and parts; rows that are not numbers are near to none."""
    x = np.frombuffer(vecs, float if len(vecs) == 8 * n * columns else np.float32)
    x = x.reshape(n, columns).astype(float)
    kept = np.isfinite(x).all(axis=1)
    return (np.frombuffer(keys, np.int64)[kept], x[kept],
            np.frombuffer(labels, float)[kept], np.frombuffer(parts, np.int64)[kept])


class _Nearest:
    """The k nearest rows, among those met so far, of each query of a block.

    Rough products in single precision, with room for their rounding, choose candidates
    within the k-th distance so far; those are measured exactly. Where that room lets too
    many pass, the products are made in double precision.
    """

    def __init__(self, queries: tuple[np.ndarray, ...], k: int, digits: int | None) -> None:
        self.keys, self.x, _, self.parts = queries
        self.k, self.digits = k, digits
        self.step = 1e-8 if digits is None else max(1e-8, 10.0 ** -digits)
        n = len(self.x)
        self.middle = self.x.mean(axis=0)
        b = self.x - self.middle
        self.square = (b * b).sum(axis=1)
        self.wide = np.hstack([b, np.ones((n, 1))])
        with np.errstate(over="ignore"):
            self.narrow = self.wide.astype(np.float32)
        # One place for all products: fresh memory costs as much as they do.
        self.products = np.empty(PANEL_QUERIES * PANEL_ROWS, np.float32)
        self.far = np.full((n, k), np.inf)
        self.ids = np.full((n, k), NO_KEY)
        self.labels = np.zeros((n, k))

    def meet(self, rows: tuple[np.ndarray, ...]) -> None:
        for first in range(0, len(rows[0]), PANEL_ROWS):
            self._panel(*[v[first:first + PANEL_ROWS] for v in rows])

    def _panel(self, ids: np.ndarray, x: np.ndarray, labels: np.ndarray, parts: np.ndarray
               ) -> None:
        a = x - self.middle
        square = (a * a).sum(axis=1)
        # The product of both is the less, the farther a row is: (|b|^2 - |b - a|^2) / 2.
        wide = np.hstack([a, -square[:, None] / 2])
        size = self.square + square.max()
        single = size.max() < 1e30
        narrow = wide.astype(np.float32) if single else wide
        shared = np.intersect1d(parts, self.parts)
        for first in range(0, len(self.x), PANEL_QUERIES):
            some = slice(first, first + PANEL_QUERIES)
            apart = parts[None, :] != self.parts[some, None] if len(shared) else None
            near = None
            if single:
                room = size[some] * (x.shape[1] + 16) * 2.0**-23 + 1e-9
                product = self.products[:len(room) * len(x)].reshape(len(room), len(x))
                np.matmul(self.narrow[some], narrow.T, out=product)
                near = self._candidates(product, some, room, apart)
            if near is None or len(near) > MANY * len(self.x[some]):
                near = self._candidates(
                    self.wide[some] @ wide.T, some, size[some] * 1e-9 + 1e-9, apart)
            i, j = np.divmod(near, len(x))
            most = max(1, 64 * CANDIDATES // x.shape[1])
            for start in range(0, len(near), most):
                part = slice(start, start + most)
                self._take(first + i[part], ids[j[part]], x[j[part]], labels[j[part]])

    def _candidates(self, product: np.ndarray, some: slice, room: np.ndarray,
                    apart: np.ndarray | None) -> np.ndarray:
        """Places in ``product`` of the pairs that may be among the k nearest."""
        far, square = self.far[some, -1].copy(), self.square[some]
        if apart is not None:
            product[~apart] = -np.inf
        new = np.flatnonzero(np.isinf(far))
        if len(new) and product.shape[1] >= self.k:
            place = product.shape[1] - self.k
            border = np.partition(product[new], place, axis=1)[:, place]
            far[new] = np.sqrt(np.maximum(square[new] - 2 * (border - room[new]), 0.0))
        least = (square - (far + self.step) ** 2) / 2 - room
        least = np.maximum(least, np.finfo(product.dtype).min)
        return np.flatnonzero(product >= least.astype(product.dtype)[:, None])

    def _take(self, i: np.ndarray, ids: np.ndarray, x: np.ndarray, labels: np.ndarray) -> None:
        gap = x - self.x[i]
        exact = np.sqrt((gap * gap).sum(axis=1))
        exact = exact if self.digits is None else np.round(exact, self.digits)
        last = self.far[i, -1]
        kept = (exact < last) | ((exact == last) & (ids < self.ids[i, -1]))
        i, exact, ids, labels = i[kept], exact[kept], ids[kept], labels[kept]
        if not len(i):
            return
        own = i[np.concatenate(([True], i[1:] != i[:-1]))]
        i = np.concatenate([np.repeat(own, self.k), i])
        exact = np.concatenate([self.far[own].ravel(), exact])
        ids = np.concatenate([self.ids[own].ravel(), ids])
        labels = np.concatenate([self.labels[own].ravel(), labels])
        order = np.lexsort((ids, exact, i))
        place = np.arange(len(i)) - np.searchsorted(i[order], i[order])
        best = order[place < self.k]
        self.far[own] = exact[best].reshape(-1, self.k)
        self.ids[own] = ids[best].reshape(-1, self.k)
        self.labels[own] = labels[best].reshape(-1, self.k)

    def found(self) -> pd.DataFrame:
        query, place = np.nonzero(np.isfinite(self.far))
        return pd.DataFrame({
            "qid": self.keys[query], "id": pd.Series(self.ids[query, place]).astype(
                "Int64").where(self.ids[query, place] != NO_KEY),
            "label": self.labels[query, place], "distance": self.far[query, place]})


def _search_tiles(rows: DataFrame, asked: DataFrame, k: int, n_rows: int, columns: int,
                  digits: int | None) -> DataFrame:
    """The nearest rows in every tile for every query: each tile and block is a task.

    The queries of a block are held, the rows of the tile pass by, both packed.
    """
    most = max(1, min(TILE_ROWS, TILE_BYTES // (8 * columns)))
    n_asked = asked.count()
    tiles, blocks = -(-n_rows // most), max(min(n_asked, LEAST_BLOCKS), -(-4 * n_asked // most))
    names = [c.split()[0] for c in PACKED.split(", ")][1:]

    def everywhere(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = _packed(asked.withColumn("label", F.lit(0.0)), blocks).select(
        everywhere(tiles).alias("tile"), F.col("at").alias("block"), F.lit(0).alias("kind"), *names)
    right = _packed(rows, tiles).select(
        F.col("at").alias("tile"), everywhere(blocks).alias("block"), F.lit(1).alias("kind"),
        *names)
    # A tile and a block are little data and much work: Spark must not put several together.
    both = left.unionByName(right).repartition(4 * tiles * blocks, "tile", "block")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, nearest = None, [], None
        for batch in batches:
            for piece in batch.itertuples(index=False):
                if (piece.tile, piece.block) != at:
                    if nearest is not None:
                        yield nearest.found()
                    at, held, nearest = (piece.tile, piece.block), [], None
                values = _unpacked(*[getattr(piece, c) for c in names], columns)
                if piece.kind == 0:
                    held.append(values)
                elif held and len(values[0]):
                    if nearest is None:
                        nearest = _Nearest(
                            tuple(np.concatenate(v) for v in zip(*held)), k, digits)
                        held = [()]
                    nearest.meet(values)
        if nearest is not None:
            yield nearest.found()

    return both.sortWithinPartitions("tile", "block", "kind").mapInPandas(stream, FOUND)


def _search(leaves: DataFrame, queries: DataFrame, block_rows: int, search) -> DataFrame:
    """The nearest rows in its cell for each row of ``queries``."""
    asked = queries.groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("blocks"))
    left = leaves.join(asked, "cell").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = queries.join(asked, "cell").withColumn(
        "block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    return left.select("cell", "block", "key", "vec", "label", "part").groupBy(
        "cell", "block").cogroup(
        right.select("cell", "block", "key", "vec", "part").groupBy("cell", "block")
    ).applyInPandas(search, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _of_members(best: DataFrame, members: DataFrame) -> DataFrame:
    return members.join(best, F.col("first_key") == F.col("qid")).select(
        F.col("key").alias("qid"), "id", "label", "distance", "rank")


def nearest_neighbours(
    train: DataFrame,
    queries: DataFrame,
    k: int = 5,
    pivots: int | None = None,
    block_rows: int = BLOCK_ROWS,
    part: str | None = None,
    group: str | None = None,
    metric: str = "euclidean",
    digits: int | None = DISTANCE_DIGITS,
) -> DataFrame:
    """``qid, id, label, distance, rank`` of the k nearest training rows per query.

    ``train`` holds ``id, vec, label`` and ``queries`` ``qid, vec``; ids are unique
    integers and vectors arrays of doubles. Distances (``euclidean`` or ``chebyshev``) are
    rounded to ``digits`` decimals; ties go to the smaller id. ``pivots`` sets the cells of
    the first level. With ``part``, a column of both, only rows of other parts are
    neighbours, so that one search answers all folds of a cross-validation; with ``group``
    only rows of the same group are.
    """
    spark = train.sparkSession

    def given(name: str | None, otherwise: int) -> Column:
        return (F.col(name) if name else F.lit(otherwise)).cast("long")

    rows = train.select(
        F.col("id").cast("long").alias("key"), "vec", F.col("label").cast("double").alias("label"),
        given(part, 0).alias("part"), given(group, 0).alias("cell"))
    asked = queries.select(F.col("qid").cast("long").alias("key"), "vec",
                           given(part, 1).alias("part"), given(group, 0).alias("cell"))
    if not rows.take(1) or not asked.take(1):
        return spark.createDataFrame([], FOUND + ", rank int")
    # Without rounding, distances between near values of one size are exact.
    slack = _SLACK if digits is not None else 1e-15
    search = _search_block(k, metric, digits)
    alike = ["cell", "part", "vec"]
    least = F.row_number().over(Window.partitionBy(*alike).orderBy("key"))
    rows = materialise(
        rows.withColumn("place", least).filter(F.col("place") <= k).drop("place"), "knn-rows")
    n_rows = rows.count()
    once = materialise(asked.groupBy(*alike).agg(F.min("key").alias("first_key")), "knn-once")
    members = materialise(asked.join(once, alike).select("key", "first_key"), "knn-asked")
    asked = once.select(F.col("first_key").alias("key"), "vec", "part", "cell")
    tiled = metric == "euclidean" and group is None and n_rows > PROBED_ROWS
    columns = rows.select(F.size("vec")).first()[0] if tiled else 0
    begun = _first_level(rows, pivots, metric)
    if tiled and columns >= PROBED_COLUMNS and _many_children(
            asked, begun, k, n_rows, block_rows, search, slack):
        best = _best(_search_tiles(rows, asked, k, n_rows, columns, digits), k)
        return _of_members(best, members)
    leaves, levels = _divide(rows, pivots, metric, begun)
    groups = asked.select("key", F.col("cell").alias("first_cell"))
    at_home = materialise(_down_home(asked, levels, metric), "knn-queries")
    first = materialise(_search(leaves, at_home, block_rows, search), "knn-near")
    bounded = materialise(_bounded(first, at_home, groups, k), "knn-bounded")
    if tiled and _many_cells(bounded, levels, n_rows, slack):
        best = _best(_search_tiles(rows, asked, k, n_rows, columns, digits), k)
    else:
        routed = materialise(_down_within(bounded, levels, metric, slack), "knn-within")
        second = _search(leaves, routed, block_rows, search)
        best = _best(first.unionByName(second), k)
    return _of_members(best, members)


def vote(neighbours: DataFrame) -> DataFrame:
    """``qid, prediction, votes``: most frequent label, ties to the smallest label."""
    counts = neighbours.groupBy("qid", "label").agg(F.count("*").alias("votes"))
    return counts.groupBy("qid").agg(
        F.max_by("label", F.struct("votes", -F.col("label"))).alias("prediction"),
        F.max("votes").alias("votes"),
    )


def average(neighbours: DataFrame) -> DataFrame:
    """``qid, prediction``: mean label of the neighbours."""
    return neighbours.groupBy("qid").agg(F.avg("label").alias("prediction"))
