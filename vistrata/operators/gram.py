"""Linear models of many subsets of the rows from one pass over them.

Each part of the rows (a fold, say) is reduced to the sums of products of its columns:
X'X, X'y, y'y, the column sums and the count. These sums add up, so the sums of all rows
but one fold are those of all less the fold's, and every least-squares, ridge or lasso
fit, and its error on the fold, follows from them without another look at the rows.

The values are taken about a middle near their mean, so that little is lost to
cancellation. The driver holds one matrix of (columns + 2) squared for each part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vistrata.functions.packed import sum_vectors

# Rows whose mean is the middle; any middle gives the right sums.
MIDDLE_ROWS = 1_000
MAX_ROUNDS, TOLERANCE = 1_000, 1e-12


@dataclass
class Moments:
    """Sums of products of ``1, inputs, label`` about ``middle``."""

    gram: np.ndarray
    middle: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.gram + other.gram, self.middle)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.gram - other.gram, self.middle)

    @property
    def n(self) -> int:
        return int(round(self.gram[0, 0]))

    def centred(self) -> tuple[np.ndarray, np.ndarray]:
        """Means about ``middle`` and sums of products about the means."""
        means = self.gram[0, 1:] / max(self.gram[0, 0], 1)
        return means, self.gram[1:, 1:] - self.gram[0, 0] * np.outer(means, means)


def moments_by_part(rows: DataFrame, inputs: list[str], part: Column,
                    count: Column | None = None) -> dict[int, Moments]:
    """The moments of every part of the rows, from one scan; rows hold no missing values.

    A row stands for ``count`` equal ones.
    """
    names = [*inputs, "label"]
    middle = rows.select(*names).limit(MIDDLE_ROWS).agg(*[F.avg(c) for c in names]).first()
    middle = np.array([m or 0.0 for m in middle], float)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            z = np.column_stack([np.ones(len(batch)), batch[names].to_numpy(float) - middle])
            parts, counts = batch["_part"].to_numpy(), batch["_count"].to_numpy(float)
            for p in np.unique(parts):
                own, n = z[parts == p], counts[parts == p]
                sums[int(p)] = sums.get(int(p), 0.0) + own.T @ (own * n[:, None])
        if sums:
            keys = [(p, i) for p, g in sums.items() for i in range(len(g))]
            yield pd.DataFrame({"part": [k[0] for k in keys], "row": [k[1] for k in keys],
                                "sums": [sums[p][i].tobytes() for p, i in keys]})

    count = F.lit(1) if count is None else count
    sent = rows.select(
        *names, part.cast("long").alias("_part"), count.alias("_count")).mapInPandas(
        products, "part long, row long, sums binary")
    size = len(names) + 1
    out: dict[int, Moments] = {}
    for r in sum_vectors(sent, ["part", "row"]).collect():
        found = out.setdefault(r["part"], Moments(np.zeros((size, size)), middle))
        found.gram[r["row"]] = np.frombuffer(r["sums"])
    return out


@dataclass
class Line:
    intercept: float
    coefficients: np.ndarray

    def r2(self, held_out: Moments) -> float | None:
        """R2 on the rows behind ``held_out``; NULL for none."""
        if not held_out.n:
            return None
        shifted = self.intercept + self.coefficients @ held_out.middle[:-1] - held_out.middle[-1]
        along = np.concatenate(([-shifted], -self.coefficients, [1.0]))
        wrong = max(0.0, float(along @ held_out.gram @ along))
        spread = float(held_out.centred()[1][-1, -1])
        # What rounding leaves of a spread or an error of nothing.
        nothing = 1e-14 * max(held_out.gram[-1, -1], 1e-300)
        if spread <= nothing:
            return 1.0 if wrong <= nothing else 0.0
        return 1 - wrong / spread


def fit_line(kind: str, moments: Moments, alpha: float = 1.0, scaled: bool = False) -> Line:
    """Least squares (``Linear Regression``), ``Ridge`` or ``Lasso`` with an intercept.

    The ridge penalty is ``alpha`` times the squares of the coefficients on the summed
    squared error, the lasso's ``alpha`` times their sizes on half the mean squared error.
    With ``scaled`` the penalties meet the coefficients of standardised inputs. Inputs
    without spread get 0; dependent ones share the fit of least norm.
    """
    n = max(moments.n, 1)
    means, products = moments.centred()
    xx, xy = products[:-1, :-1], products[:-1, -1]
    size = np.sqrt(np.maximum(np.diag(xx), 0.0))
    # A spread that is only what rounding left of equal values counts as none.
    size[size <= 1e-7 * np.sqrt(np.maximum(np.diag(moments.gram)[1:-1], 1e-300))] = 0.0
    live = np.flatnonzero(size > 0)
    unit = np.zeros(len(size))
    unit[live] = 1.0 / size[live]
    # To inputs of size 1 (penalties adapt), where the sums are well scaled.
    corr = (xx * np.outer(unit, unit))[np.ix_(live, live)]
    right = (xy * unit)[live]
    weight = 1.0 / (n - 1 if n > 1 else 1) if scaled else unit[live] ** 2
    beta = np.zeros(len(size))
    if kind == "Linear Regression":
        beta[live] = _least_squares(corr, right)
    elif kind == "Ridge":
        penal = alpha * weight * np.ones(len(live))
        beta[live] = _least_squares(corr + np.diag(penal), right)
    elif kind == "Lasso":
        beta[live] = _lasso(corr, right, n * alpha * np.sqrt(weight) * np.ones(len(live)))
    else:
        raise ValueError(f"{kind} is no linear model")
    coefficients = beta * unit
    centre = moments.middle + means
    return Line(float(centre[-1] - coefficients @ centre[:-1]), coefficients)


def _least_squares(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cholesky where the inputs are independent, else the solution of least norm."""
    try:
        factor = np.linalg.cholesky(left)
        if np.diag(factor).min(initial=1.0) > 1e-6:
            return np.linalg.solve(factor.T, np.linalg.solve(factor, right))
    except np.linalg.LinAlgError:
        pass
    return np.linalg.pinv(left, rcond=1e-12, hermitian=True) @ right


def _lasso(corr: np.ndarray, right: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Coordinate descent on the sums: each step is exact for one coefficient."""
    beta = np.zeros(len(right))
    rest = right.copy()
    scale = np.abs(right).max(initial=0.0)
    for _ in range(MAX_ROUNDS):
        moved = 0.0
        for j in range(len(beta)):
            pull = rest[j] + corr[j, j] * beta[j]
            new = np.sign(pull) * max(abs(pull) - penalty[j], 0.0) / corr[j, j]
            step = new - beta[j]
            if step:
                rest -= corr[:, j] * step
                beta[j] = new
                moved = max(moved, abs(step))
        if moved <= TOLERANCE * max(scale, 1e-300):
            break
    return beta


def fold_scores(moments: dict[int, Moments], kind: str, alpha: float = 1.0, scaled: bool = False
                ) -> dict[int, float | None]:
    """R2 on each part of the line fitted to all other parts."""
    parts = sorted(moments)
    if not parts:
        return {}
    whole = moments[parts[0]]
    for p in parts[1:]:
        whole = whole + moments[p]
    return {p: fit_line(kind, whole - moments[p], alpha, scaled).r2(moments[p]) for p in parts}
