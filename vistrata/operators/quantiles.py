"""Exact, linearly interpolated quantiles that do not gather a column anywhere.

Spark's ``percentile`` is exact but keeps every distinct value of a column in
one buffer. It is used here only for columns whose number of distinct values is
known to be small. For the others the order statistics are located by
narrowing: a bounded sketch (``percentile_approx``) brackets each wanted rank,
one scan counts the rows below and inside each bracket, and this repeats until
a bracket holds few enough rows to look at. Every bracket is verified by exact
counts, so the sketch's error never reaches the result. The scans read single
columns and shuffle nothing but sketches and counts.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from vistrata.functions.aggregates import fit_scalars
from vistrata.functions.columns import as_double, col, normalise_missing, require_numeric
from vistrata.operators.lookup import attach_by_value, value_sizes
from vistrata.operators.ordered import running_totals

# Distinct values that Spark's exact aggregate may hold in one buffer.
BUFFERED_VALUES = 100_000
# The estimate of distinct values has a standard error of 5 %: ten of them.
SKETCH_ROOM = 1.5
# Rows of a bracket that may be brought to the driver to finish a rank.
BRACKET_ROWS = 20_000
# percentile_approx keeps ranks within n / SKETCH_ACCURACY.
SKETCH_ACCURACY = 10_000
GRID = 256
# Crowded groups whose quantiles are narrowed one by one in shared scans.
NARROWED_GROUPS = 30


def interpolate(low: float, high: float, fraction: float) -> float:
    return low if fraction == 0 or low == high else low + (high - low) * fraction


@dataclass
class _Bracket:
    """Search state of neighbouring order statistics of one expression."""

    # Brackets of the same expression share a name.
    name: object
    source: Column
    # Ranks (0-based) still to be found, and those found.
    ranks: set[int]
    low: float | None = None
    high: float | None = None
    # An open bracket excludes its end values: no open rank lies on them.
    open: bool = False
    slack: int = 1
    below: int = 0
    found: dict[int, float] = field(default_factory=dict)

    def holds(self, value: float) -> bool:
        if self.open:
            return (self.low is None or value > self.low) and (self.high is None or value < self.high)
        return (self.low is None or value >= self.low) and (self.high is None or value <= self.high)

    def resolve(self, rank: int, value: float) -> None:
        self.ranks.discard(rank)
        self.found[rank] = value


def _by_name(brackets: list[_Bracket]) -> dict[object, list[_Bracket]]:
    groups: dict[object, list[_Bracket]] = {}
    for b in brackets:
        groups.setdefault(b.name, []).append(b)
    return groups


def _cell(x: Column, edges: list[float], first: int = 0) -> Column:
    """Place of x among sorted edges: 2i in the gap before edge i, 2i + 1 on it."""
    if not edges:
        return F.lit(2 * first)
    middle = len(edges) // 2
    edge = F.lit(edges[middle])
    return (
        F.when(x < edge, _cell(x, edges[:middle], first))
        .when(x == edge, 2 * (first + middle) + 1)
        .otherwise(_cell(x, edges[middle + 1 :], first + middle + 1))
    )


def _count(df: DataFrame, brackets: list[_Bracket]) -> list[tuple[int, int, int, int]]:
    """Rows below, inside, at the low end and at the high end of each bracket.

    All bracket ends of an expression cut its values into cells; one grouped count
    of the cells answers every bracket.
    """
    groups = _by_name(brackets)
    edges = {
        name: sorted({e for b in group for e in (b.low, b.high) if e is not None})
        for name, group in groups.items()
    }
    cells = F.array(*[
        F.struct(F.lit(i).alias("i"), F.when(x.isNotNull(), _cell(x, edges[name])).alias("cell"))
        for i, (name, x) in enumerate((n, g[0].source) for n, g in groups.items())
    ])
    counts = (
        df.select(F.explode(cells).alias("c")).select("c.*").filter("cell is not null")
        .groupBy("i", "cell").agg(F.count("*").alias("n")).collect()
    )
    filled = {name: [0] * (2 * len(edges[name]) + 1) for name in groups}
    names = list(groups)
    for i, cell, n in counts:
        filled[names[i]][cell] = n

    def measure(b: _Bracket) -> tuple[int, int, int, int]:
        n, ends = filled[b.name], edges[b.name]
        first = 0 if b.low is None else 2 * ends.index(b.low) + 1
        last = len(n) - 1 if b.high is None else 2 * ends.index(b.high) + 1
        if b.open:
            first = first if b.low is None else first + 1
            last = last if b.high is None else last - 1
            return sum(n[:first]), sum(n[first : last + 1]), 0, 0
        at_low = 0 if b.low is None else n[first]
        at_high = 0 if b.high is None else n[last]
        return sum(n[:first]), sum(n[first : last + 1]), at_low, at_high

    return [measure(b) for b in brackets]


def _locate(df: DataFrame, brackets: list[_Bracket], bracket_rows: int) -> None:
    """Find all ranks of all brackets by repeated narrowing.

    A round counts cells over all rows; a new sketch is made only for brackets that
    are still wide, from the rows inside them.
    """
    active, readable = list(brackets), []
    while active:
        missed, wide = [], []
        for b, (below, inside, at_low, at_high) in zip(active, _count(df, active)):
            if min(b.ranks) < below or max(b.ranks) >= below + inside:
                # The bracket missed a rank: open it up and look again.
                b.low, b.high, b.open, b.slack = None, None, False, b.slack * 4
                missed.append(b)
                continue
            for rank in sorted(b.ranks):
                if rank - below < at_low:
                    b.resolve(rank, b.low)
                elif rank - below >= inside - at_high:
                    b.resolve(rank, b.high)
            if b.ranks and inside <= bracket_rows:
                b.below = below
                readable.append(b)
            elif b.ranks:
                wide.append((b, below, inside))
        if wide:
            grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
            points = fit_scalars(df, {
                i: F.percentile_approx(F.when(_within(b.source, [b]), b.source), grid,
                                       SKETCH_ACCURACY)
                for i, (b, _, _) in enumerate(wide)
            })
            for i, (b, below, inside) in enumerate(wide):
                _narrow(b, points[i], below, inside)
        active = missed + [b for b, _, _ in wide]
    if readable:
        _read(df, readable)


def _within(x: Column, brackets: list[_Bracket]) -> Column:
    """Whether x lies in one of the brackets, ends included."""
    spans: list[list[float]] = []
    infinity = float("inf")
    for low, high in sorted(
        (-infinity if b.low is None else b.low, infinity if b.high is None else b.high)
        for b in brackets
    ):
        if spans and low <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], high)
        else:
            spans.append([low, high])

    def search(part: list[list[float]]) -> Column:
        if len(part) == 1:
            return (x >= F.lit(part[0][0])) & (x <= F.lit(part[0][1]))
        middle = len(part) // 2
        return F.when(x < F.lit(part[middle][0]), search(part[:middle])).otherwise(
            search(part[middle:]))

    return F.coalesce(search(spans), F.lit(False))


def _narrow(b: _Bracket, points: list[float], below: int, inside: int) -> None:
    """Next bracket around the grid positions of the ranks. A heavy value may fill a
    whole bracket, so one that did not shrink is continued without its ends."""
    first = math.floor((min(b.ranks) - below) / inside * GRID) - b.slack
    last = math.ceil((max(b.ranks) - below) / inside * GRID) + b.slack
    low = points[first] if first >= 0 else b.low
    high = points[last] if last <= GRID else b.high
    if (low, high) == (b.low, b.high):
        b.open = True
    else:
        b.low, b.high, b.open = low, high, False


def _read(df: DataFrame, brackets: list[_Bracket]) -> None:
    """Finish brackets with few rows from their value counts."""
    groups = _by_name(brackets)
    within = {name: _within(group[0].source, group) for name, group in groups.items()}
    near = df.filter(reduce(lambda a, b: a | b, within.values()))
    hits = F.array(*[
        F.struct(F.lit(i).alias("i"), F.when(within[name], group[0].source).alias("v"))
        for i, (name, group) in enumerate(groups.items())
    ])
    rows = (
        near.select(F.explode(hits).alias("hit")).select("hit.*").filter("v is not null")
        .groupBy("i", "v").agg(F.count("*").alias("n")).collect()
    )
    names = list(groups)
    values: dict[object, list[tuple[float, int]]] = {name: [] for name in names}
    for i, value, n in rows:
        values[names[i]].append((value, n))
    for b in brackets:
        pairs = sorted(pair for pair in values[b.name] if b.holds(pair[0]))
        ends = list(accumulate(n for _, n in pairs))
        for rank in list(b.ranks):
            b.resolve(rank, pairs[bisect_right(ends, rank - b.below)][0])


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    buffered_values: int = BUFFERED_VALUES,
    bracket_rows: int = BRACKET_ROWS,
) -> dict[str, list[float | None]]:
    """Quantiles of several numeric columns at once, missing values skipped."""
    require_numeric(df, *columns)
    clean = normalise_missing(df).select(*[as_double(df, c).alias(c) for c in columns])
    sizes = fit_scalars(
        clean,
        {f"n_{c}": F.count(col(c)) for c in columns}
        | {f"d_{c}": F.approx_count_distinct(col(c)) for c in columns},
    )
    result: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    filled = [c for c in columns if sizes[f"n_{c}"]]
    buffered = [
        c for c in filled
        if min(sizes[f"n_{c}"], SKETCH_ROOM * sizes[f"d_{c}"]) <= buffered_values
    ]
    narrowed = [c for c in filled if c not in buffered]

    if buffered:
        wanted = F.array(*[F.lit(float(p)) for p in probabilities])
        found = fit_scalars(clean, {c: F.percentile(col(c), wanted) for c in buffered})
        result |= {c: list(found[c]) for c in buffered}
    if narrowed:
        sources = {c: (col(c), sizes[f"n_{c}"]) for c in narrowed}
        result |= _narrowed_quantiles(clean, sources, probabilities, bracket_rows)
    return result


def _narrowed_quantiles(
    df: DataFrame,
    sources: dict[object, tuple[Column, int]],
    probabilities: list[float],
    bracket_rows: int,
) -> dict:
    """Quantiles by narrowing; ``sources`` maps a name to an expression and its row count."""
    margin = 2.0 / SKETCH_ACCURACY
    edges = [e for p in probabilities for e in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = F.array(*[F.lit(e) for e in edges])
    first = fit_scalars(
        df, {c: F.percentile_approx(x, sketch, SKETCH_ACCURACY) for c, (x, _) in sources.items()}
    )
    brackets: dict[tuple, _Bracket] = {}
    for c, (x, n) in sources.items():
        for j, p in enumerate(probabilities):
            place = p * (n - 1)
            brackets[c, j] = _Bracket(
                c, x, {math.floor(place), math.ceil(place)},
                first[c][2 * j] if p > margin else None,
                first[c][2 * j + 1] if p < 1 - margin else None,
            )
    _locate(df, list(brackets.values()), bracket_rows)
    result: dict = {c: [None] * len(probabilities) for c in sources}
    for (c, j), b in brackets.items():
        place = probabilities[j] * (sources[c][1] - 1)
        low, high = math.floor(place), math.ceil(place)
        result[c][j] = interpolate(b.found[low], b.found[high], place - low)
    return result


def kth_smallest(
    df: DataFrame, requests: dict[str, tuple[Column, int, float | None, float | None]]
) -> dict[str, float]:
    """Order statistics of numeric expressions; NULLs are skipped.

    A request is ``(expression, 0-based rank, low, high)``; the bounds are a guess
    of where the value lies and may be None.
    """
    brackets = {
        name: _Bracket(name, source, {k}, low, high) for name, (source, k, low, high) in requests.items()
    }
    _locate(df, list(brackets.values()), BRACKET_ROWS)
    return {name: b.found[requests[name][1]] for name, b in brackets.items()}


def quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    """``column, probability, value`` for every column and probability."""
    found = exact_quantiles(df, columns, probabilities)
    rows = [(c, float(p), v) for c in columns for p, v in zip(probabilities, found[c])]
    return df.sparkSession.createDataFrame(
        rows, "column string, probability double, value double"
    )


def grouped_quantiles(
    df: DataFrame,
    group: str,
    column: str,
    probabilities: list[float],
    buffered_values: int = BUFFERED_VALUES,
    narrowed_groups: int = NARROWED_GROUPS,
) -> DataFrame:
    """Exact quantiles of ``column`` per group: ``group, n, q0, q1, ...``.

    A group with few distinct values goes through Spark's exact aggregate. A few
    crowded groups are narrowed like columns of their own. Many crowded groups are
    not gathered either: the (group, value) frequencies are ordered over all groups
    together and each quantile is read off the running totals.
    """
    require_numeric(df, column)
    clean = (
        normalise_missing(df)
        .select(col(group).alias(group), as_double(df, column).alias("value"))
        .na.drop()
    )
    sizes = clean.groupBy(group).agg(
        F.count("*").alias("n"), F.approx_count_distinct("value").alias("d")
    )
    crowded = F.least(F.col("n"), F.col("d") * SKETCH_ROOM) > buffered_values
    hot = sizes.filter(crowded).limit(narrowed_groups + 1).collect()
    names = [f"q{i}" for i in range(len(probabilities))]
    if len(hot) <= narrowed_groups:
        values = [r[group] for r in hot]
        small = clean.filter(~col(group).isin(values)) if hot else clean
        wanted = F.array(*[F.lit(float(p)) for p in probabilities])
        summary = small.groupBy(group).agg(
            F.count("*").alias("n"), F.percentile("value", wanted).alias("q")
        ).select(group, "n", *[F.col("q")[i].alias(name) for i, name in enumerate(names)])
        if not hot:
            return summary
        members = clean.filter(col(group).isin(values))
        found = _narrowed_quantiles(
            members,
            {r[group]: (F.when(col(group) == r[group], F.col("value")), r["n"]) for r in hot},
            probabilities, BRACKET_ROWS,
        )
        rows = [(r[group], r["n"], *found[r[group]]) for r in hot]
        return summary.unionByName(df.sparkSession.createDataFrame(rows, summary.schema))

    pairs = sizes.agg(F.sum("d")).first()[0]
    frequencies = clean.groupBy(group, "value").agg(F.count("*").alias("rows"))
    ordered = running_totals(frequencies, [group, "value"], ["rows"], pairs)
    totals = ordered.groupBy(F.col(group).alias("value")).agg(
        F.count("*").alias("n_rows"),
        F.sum("rows").alias("n"),
        F.min("before_rows").alias("start"),
    )
    # A group's totals go to its values as a lookup, so a crowded group is no hot key.
    placed = attach_by_value(
        ordered, group, totals, value_sizes(frequencies, [group])[group]
    ).withColumn("first", F.col("before_rows") - F.col("start"))
    last = F.col("first") + F.col("rows") - 1
    picks = []
    for name, p in zip(names, probabilities):
        place = F.lit(float(p)) * (F.col("n") - 1)
        for side, rank in (("low", F.floor(place)), ("high", F.ceil(place))):
            hit = (F.col("first") <= rank) & (rank <= last)
            picks.append(F.max(F.when(hit, F.col("value"))).alias(f"{name}_{side}"))
    read = placed.groupBy(group, "n").agg(*picks)

    def value(name: str, p: float) -> Column:
        place = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        return low + (high - low) * (place - F.floor(place))

    return read.select(
        group, "n", *[value(name, p).alias(name) for name, p in zip(names, probabilities)]
    )
