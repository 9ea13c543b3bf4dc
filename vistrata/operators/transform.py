"""Numeric column transformations, with fitted power transforms.

The power parameter of Box-Cox and Yeo-Johnson is fitted by maximum likelihood.
Each round evaluates the likelihood at a whole grid of candidates in one
scan of one column, then the grid closes in on the best candidate; the
number of rounds does not depend on the size of the table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from vistrata.functions.aggregates import fit_scalars, r4, sample_skewness
from vistrata.functions.columns import as_double, normalise_missing, require_numeric

TRANSFORMATIONS = (
    "log1p", "sqrt", "square", "standardize", "normalize", "boxcox", "yeojohnson",
)
# Start of the parameter search, candidates per round, and where rounds stop.
SEARCH_RANGE = (-2.0, 2.0)
CANDIDATES = 9
FINAL_STEP = 5e-4


def log1p(x: Column) -> Column:
    """ln(1 + x): minus infinity at -1, missing below."""
    return F.when(x > -1, F.log1p(x)).when(x == -1, F.lit(float("-inf")))


def boxcox(x: Column, power: float) -> Column:
    """Box-Cox transform; defined for positive values only."""
    if power == 0:
        return F.when(x > 0, F.log(x))
    return F.when(x > 0, (F.pow(x, F.lit(power)) - 1) / power)


def yeojohnson(x: Column, power: float) -> Column:
    if power == 0:
        upper = F.log1p(x)
    else:
        upper = (F.pow(x + 1, F.lit(power)) - 1) / power
    if power == 2:
        lower = -F.log1p(-x)
    else:
        lower = -(F.pow(1 - x, F.lit(2 - power)) - 1) / (2 - power)
    return F.when(x >= 0, upper).otherwise(F.when(x < 0, lower))


_FORMULAS = {"boxcox": boxcox, "yeojohnson": yeojohnson}
# The logarithms that the power multiplies, and those that two minus the power does.
_LOGARITHMS = {
    "boxcox": lambda x: (F.when(x > 0, F.log(x)), F.lit(None).cast("double")),
    "yeojohnson": lambda x: (F.when(x >= 0, F.log1p(x)), F.when(x < 0, F.log1p(-x))),
}


@dataclass
class _Logarithms:
    """Rows ``up, down`` of a column, one of them NULL, and their extent.

    A column of one side is centred on its mean logarithm, that is divided by its
    geometric mean: what a power makes of it then neither cancels nor overflows,
    however far from 1 the values are.
    """

    rows: DataFrame
    n: int
    slope: float
    centre: dict[str, float]
    ends: dict[str, tuple[float, float]]

    @property
    def two_sided(self) -> bool:
        return len(self.ends) == 2

    @property
    def spread(self) -> float:
        """How far the logarithms reach; 0 without two different values."""
        if self.two_sided:
            return max(high for _, high in self.ends.values())
        return max((high - low for low, high in self.ends.values()), default=0.0)

    def top(self, power: float) -> float:
        """The largest exponent of any row, 0 at least."""
        return max(0.0, *(
            _exponent(side, power) * (end - self.centre[side])
            for side, ends in self.ends.items() for end in ends))


def _exponent(side: str, power: float) -> float:
    return power if side == "up" else 2 - power


def _logarithms(df: DataFrame, column: str, method: str) -> _Logarithms:
    x = F.col("x")
    up, down = _LOGARITHMS[method](x)
    rows = (
        normalise_missing(df).select(as_double(df, column).alias("x"))
        .filter(F.abs(x) < float("inf")).select(up.alias("up"), down.alias("down"))
    )
    seen = fit_scalars(rows, {
        f"{kind}_{side}": f(side) for side in ("up", "down")
        for kind, f in (("n", F.count), ("sum", F.sum), ("low", F.min), ("high", F.max))})
    sides = [side for side in ("up", "down") if seen[f"n_{side}"]]
    return _Logarithms(
        rows, sum(seen[f"n_{side}"] for side in sides),
        (seen["sum_up"] or 0.0) - (seen["sum_down"] or 0.0),
        {side: 0.0 if len(sides) == 2 else seen[f"sum_{side}"] / seen[f"n_{side}"]
         for side in sides},
        {side: (seen[f"low_{side}"], seen[f"high_{side}"]) for side in sides})


def _raised(logs: _Logarithms, side: str, power: float, top: float) -> Column:
    """The transformed rows of one side, over exp(top)."""
    exponent, scale = _exponent(side, power), math.exp(-top)
    t = F.col(side) - F.lit(logs.centre[side])
    if exponent == 0:
        return t * scale
    t = t * F.lit(exponent)
    return F.when(t > 1, F.exp(t - F.lit(top)) - scale).otherwise(F.expm1(t) * scale) / exponent


def _likelihoods(logs: _Logarithms, powers: list[float]) -> list[float]:
    candidates = []
    for i, p in enumerate(powers):
        parts = {side: _raised(logs, side, p, logs.top(p)) for side in logs.ends}
        if "down" in parts:
            parts["down"] = -parts["down"]
        candidates.append(F.struct(F.lit(i).alias("i"), F.coalesce(*parts.values()).alias("y")))
    found = logs.rows.select(F.explode(F.array(*candidates)).alias("c")).groupBy("c.i").agg(
        F.var_pop("c.y").alias("spread"))
    result = [float("-inf")] * len(powers)
    for i, spread in found.collect():
        if spread and np.isfinite(spread):
            p = powers[i]
            result[i] = -logs.n / 2 * (2 * logs.top(p) + math.log(spread))
            if logs.two_sided:
                result[i] += (p - 1) * logs.slope
    return result


def log_likelihoods(df: DataFrame, column: str, method: str, powers: list[float]) -> list:
    """Profile log-likelihood per candidate power, up to a constant, all from one scan.

    Each value meets all candidates inside its task; only one partial variance per
    candidate leaves it. Infinite values are left out.
    """
    logs = _logarithms(df, column, method)
    return _likelihoods(logs, powers) if logs.n else [float("-inf")] * len(powers)


def fit_power(df: DataFrame, column: str, method: str) -> float:
    """Maximum-likelihood power; raises for a column without spread.

    The likelihood falls without bound to both sides, so a range that is widened
    to the side of its best end holds the maximum after a few rounds.
    """
    logs = _logarithms(df, column, method)
    if logs.spread <= 0:
        raise ValueError(f"{method} needs at least two different usable values in {column!r}")
    # What a power does to the values depends on its product with their spread.
    low, high = (end * max(1.0, 2.0 / logs.spread) for end in SEARCH_RANGE)
    final_step = FINAL_STEP * max(1.0, 1.0 / logs.spread)
    while True:
        grid = np.linspace(low, high, CANDIDATES)
        fits = np.array(_likelihoods(logs, grid.tolist()))
        if not np.isfinite(fits).any():
            raise ValueError(f"{method} needs at least two different usable values in {column!r}")
        best, step = int(fits.argmax()), grid[1] - grid[0]
        if best in (0, CANDIDATES - 1):
            # The maximum lies outside: move the range to that side.
            low, high = grid[best] - (high - low), grid[best] + (high - low)
        elif step <= final_step:
            return _vertex(grid, fits, best)
        else:
            low, high = grid[best] - step, grid[best] + step


def _vertex(grid: np.ndarray, fits: np.ndarray, best: int) -> float:
    """Top of the parabola fitted to all candidates of the last, narrow grid."""
    if best in (0, len(grid) - 1) or not np.isfinite(fits).all():
        return float(grid[best])
    centre = grid[best]
    curve = np.polyfit(grid - centre, fits - fits[best], 2)
    return float(centre - curve[1] / (2 * curve[0])) if curve[0] < 0 else float(centre)


def transform_column(
    df: DataFrame,
    column: str,
    transformation: str,
    output_column: str | None = None,
    power: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Add the transformed column; the summary holds the skewness before and after.

    ``power`` fixes the parameter of a power transform instead of fitting it.
    """
    if transformation not in TRANSFORMATIONS:
        raise ValueError(f"transformation must be one of {TRANSFORMATIONS}")
    require_numeric(df, column)
    clean = normalise_missing(df)
    x = as_double(df, column)
    if transformation == "log1p":
        new = log1p(x)
    elif transformation == "sqrt":
        new = F.sqrt(F.when(x < 0, 0.0).otherwise(x))
    elif transformation == "square":
        new = F.pow(x, F.lit(2.0))
    elif transformation == "standardize":
        seen = fit_scalars(clean, {"mean": F.avg(x), "std": F.stddev_samp(x)})
        new = (x - F.lit(seen["mean"]).cast("double")) / (seen["std"] or 1.0)
    elif transformation == "normalize":
        seen = fit_scalars(clean, {"low": F.min(x), "high": F.max(x)})
        width = (seen["high"] or 0.0) - (seen["low"] or 0.0)
        new = (x - F.lit(seen["low"]).cast("double")) / (width or 1.0)
    else:
        power = fit_power(df, column, transformation) if power is None else power
        new = _FORMULAS[transformation](x, power)

    name = output_column or f"{column}_{transformation}"
    result = clean.withColumn(name, new)
    summary = clean.agg(
        F.lit(column).alias("column"), F.lit(name).alias("output_column"),
        F.lit(transformation).alias("transformation"),
        F.lit(power).cast("double").alias("power"),
        r4(sample_skewness(x)).alias("skew_before"),
        r4(sample_skewness(F.when(F.abs(new) < float("inf"), new))).alias("skew_after"),
    )
    return result, summary
