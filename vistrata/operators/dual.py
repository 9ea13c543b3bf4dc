"""Support vector regression and classification by dual coordinate ascent.

In regression the loss is zero within ``epsilon`` of the target and grows with the
distance beyond it; between two classes it is zero beyond the margin and grows with the
distance from it. Both have a penalty on the squared weights, and the inputs are random
features of the RBF kernel (``kernel``). The dual has one bounded number per row, and each
has a best value in closed form while the others rest (Ho and Lin, "Large-scale linear
support vector regression", JMLR 2012). The gap between the two problems bounds what is
left to gain and ends the ascent.

More classes are told apart pair by pair. Probabilities of a pair are a sigmoid of its
margins, fitted to margins of rows that were held out (Platt, 1999); those of all pairs are
brought together as in Wu, Lin and Weng, "Probability estimates for multi-class
classification by pairwise coupling" (JMLR 2004).

Rows with equal values are one row with a count. Where the table fits a task, all fits
(training rows and folds) are solved side by side, a task each. Else every task ascends on
its own rows and the steps of all tasks are added, safely scaled down by their number (Ma
et al., "Adding vs. averaging in distributed primal-dual optimization", ICML 2015); the
numbers of the rows are kept in a written table from round to round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from vistrata.operators.kernel import RandomFourierFeatures, random_features
from vistrata.operators.trees import Rows, Table, Unit, frame_score, scramble, weighted_score
from vistrata.plans.session import materialise

EPSILON, COST = 0.1, 1.0
# The ascent ends when the gap is below this share of the primal value.
GAP = 1e-3
MAX_EPOCHS, MAX_ROUNDS = 1_000, 200
# The constant input that stands for the intercept, of the size of the random features.
CONSTANT = 1.0
# Bytes of random features that a task of the large way works on, and that the rows of a
# whole table may make in one task.
TASK_FEATURES, WHOLE_FEATURES = 64 << 20, 256 << 20
# Parts of the rows of a pair that are held out in turn for its sigmoid.
SIGMOID_FOLDS, SIGMOID_GAP = 5, 1e-2


class LinearScore(Transformer, HasInputCol, HasPredictionCol, DefaultParamsReadable,
                  DefaultParamsWritable):
    """Adds the weighted sum of a vector."""

    weights = Param(Params._dummy(), "weights", "one per feature", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "added to the sum", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, predictionCol="prediction", weights=None, intercept=0.0):
        super().__init__()
        self._setDefault(intercept=0.0)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights = F.array(*[F.lit(w) for w in self.getOrDefault(self.weights)])
        products = F.zip_with(vector_to_array(F.col(self.getInputCol())), weights,
                              lambda x, w: x * w)
        total = F.aggregate(products, F.lit(self.getOrDefault(self.intercept)), lambda a, b: a + b)
        return dataset.withColumn(self.getPredictionCol(), total)

    def judge(self):
        """What finds predictions from an array of vectors."""
        weights = np.array(self.getOrDefault(self.weights))
        intercept = self.getOrDefault(self.intercept)
        return lambda x: (x @ weights + intercept, None)


@dataclass(frozen=True)
class Settings:
    size: int
    gamma: float
    seed: int
    # Mean and deviation of each input, where they are scaled.
    scaling: tuple | None = None
    cost: float = COST
    epsilon: float = EPSILON

    def features(self, x: np.ndarray) -> np.ndarray:
        if self.scaling is not None:
            mean, spread = np.array(self.scaling).T
            x = (x - mean) / spread
        lifted = random_features(x.shape[1], self.size, self.gamma, self.seed)(x)
        return np.column_stack([lifted, np.full(len(x), CONSTANT)])


@dataclass
class Problem:
    """Rows of features, targets (numbers, or -1 and 1 with ``margin``) and costs."""

    x: np.ndarray
    y: np.ndarray
    cost: np.ndarray
    epsilon: float
    margin: bool = False

    @property
    def limits(self) -> tuple[np.ndarray, np.ndarray]:
        """Between which numbers the dual variable of each row lies."""
        if self.margin:
            return np.where(self.y > 0, 0.0, -self.cost), np.where(self.y > 0, self.cost, 0.0)
        return -self.cost, self.cost

    def ascend(self, alpha: np.ndarray, w: np.ndarray, order: np.ndarray, scale: float = 1.0
               ) -> None:
        """One epoch over the rows in ``order``; ``alpha`` and ``w`` move in place."""
        sizes = np.einsum("ij,ij->i", self.x, self.x) * scale
        low, high = self.limits
        x, y, epsilon = self.x, self.y, 0.0 if self.margin else self.epsilon
        for i in order:
            pull = y[i] - x[i] @ w + sizes[i] * alpha[i]
            best = 0.0
            if pull > epsilon:
                best = (pull - epsilon) / sizes[i]
            elif pull < -epsilon:
                best = (pull + epsilon) / sizes[i]
            step = min(max(best, low[i]), high[i]) - alpha[i]
            if step:
                alpha[i] += step
                w += (step * scale) * x[i]

    def values(self, alpha: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What the rows add to the primal and to the dual value, but for the penalty."""
        found = self.x @ w
        if self.margin:
            loss = np.maximum(1 - self.y * found, 0.0)
            return np.array([(self.cost * loss).sum(), alpha @ self.y])
        loss = np.maximum(np.abs(self.y - found) - self.epsilon, 0.0)
        return np.array([(self.cost * loss).sum(),
                         alpha @ self.y - self.epsilon * np.abs(alpha).sum()])


def _gap(sums: np.ndarray, w: np.ndarray) -> float:
    """The gap as a share of the primal value."""
    primal, dual = sums[0] + w @ w / 2, sums[1] - w @ w / 2
    return (primal - dual) / max(abs(primal), 1e-300)


def solve(problem: Problem, gap: float = GAP) -> tuple[np.ndarray, float]:
    """The weights, and the gap they were left with."""
    alpha, w = np.zeros(len(problem.y)), np.zeros(problem.x.shape[1])
    draw = np.random.default_rng(0)
    left = 0.0 if not len(problem.y) else np.inf
    for epoch in range(MAX_EPOCHS if len(problem.y) else 0):
        problem.ascend(alpha, w, draw.permutation(len(problem.y)))
        if epoch % 5 == 4:
            left = _gap(problem.values(alpha, w), w)
            if left <= gap:
                break
    return w, left


@dataclass
class Solution:
    settings: Settings
    weights: np.ndarray
    gap: float
    middle: float = 0.0
    # R2 on the rows it was asked to score.
    score: float | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.settings.features(x) @ self.weights + self.middle

    def stage(self, column: str) -> LinearScore:
        return LinearScore(
            inputCol=column, weights=self.weights[:-1].tolist(),
            intercept=float(self.weights[-1] * CONSTANT + self.middle))


def _fits_a_task(table: Table, size: int) -> bool:
    """Whether the random features of all rows stay within what a task may hold."""
    return table.shared is not None and table.n * (size + 1) * 8 <= WHOLE_FEATURES


def fit_all(table: Table, fits: dict[int, tuple[frozenset, frozenset | None, Settings]],
            gap: float = GAP) -> dict[int, Solution]:
    """A solution for each fit, given by the parts it learns from and scores, and its settings."""
    size = max(how.size for _, _, how in fits.values())
    if not _fits_a_task(table, size):
        return {k: _fit_large(table, *fit, gap) for k, fit in fits.items()}
    shared, middle, spark = table.shared, table.middle, table.frame.sparkSession

    def tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, groups = shared.value
        for batch in batches:
            for i in batch["id"]:
                parts, scored, how = fits[i]
                w = rows.group_weights(Unit(i, 0, parts))
                kept = w > 0
                found, left = solve(Problem(
                    how.features(groups.x[kept]), groups.y[kept] - middle, how.cost * w[kept],
                    how.epsilon), gap)
                score = None
                if scored is not None:
                    means = Solution(how, found, left, middle).predict(groups.x)[:, None]
                    score = weighted_score(means, groups.y, rows.group_weights(
                        Unit(i, 0, scored)), 0)
                yield pd.DataFrame({"id": [i], "gap": [left], "score": [score],
                                    "weights": [found.tobytes()]})

    names = sorted(fits)
    dealt = spark.createDataFrame([(i,) for i in names], "id long").repartition(len(names), "id")
    found = dealt.mapInPandas(tasks, "id long, gap double, score double, weights binary").collect()
    return {r["id"]: Solution(fits[r["id"]][2], np.frombuffer(r["weights"]), r["gap"], middle,
                              r["score"]) for r in found}


def _fit_large(table: Table, parts: frozenset, scored: frozenset | None, how: Settings,
               gap: float) -> Solution:
    """One fit over the whole table, and its score."""
    inputs, middle = table.inputs, table.middle
    rows = table.frame.filter(F.col("_part").isin([*parts])).select(
        *inputs, (F.col("label") - middle).alias("label"), "_count", "_hash")
    found = Solution(how, *_rounds(rows, inputs, how, False, gap), middle=middle)
    if scored is not None:
        def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch[["label", "_count"]].assign(
                    found=found.predict(batch[inputs].to_numpy(float)))

        asked = table.frame.filter(F.col("_part").isin([*scored])).select(*inputs, "label", "_count")
        found.score = frame_score(
            asked.mapInPandas(predict, "label double, _count long, found double"), 0)
    return found


def _rounds(rows: DataFrame, inputs: list[str], how: Settings, margin: bool, gap: float
            ) -> tuple[np.ndarray, float]:
    """Rounds of an epoch in every task, the steps added.

    ``rows`` holds the inputs, the target as ``label``, ``_count`` and ``_hash``.
    """
    spark, kinds = rows.sparkSession, dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*inputs, "label", "_count", "_hash"])
    n = rows.count()
    # So many rows to a task; every round keeps the tasks of the one before.
    tasks = max(1, -(-n * (how.size + 1) * 8 // TASK_FEATURES))
    rows = materialise(rows.repartition(tasks, "_hash").withColumns(
        {"alpha": F.lit(0.0), "task": F.spark_partition_id()}), "dual-rows")
    w, left = np.zeros(how.size + 1), 0.0 if not n else np.inf
    def climb(start):
        def step(part: pd.DataFrame) -> pd.DataFrame:
            w, number = start.value
            problem = Problem(
                how.features(part[inputs].to_numpy(float)), part["label"].to_numpy(float),
                how.cost * part["_count"].to_numpy(float), how.epsilon, margin)
            alpha = part["alpha"].to_numpy(float).copy()
            sums, moved, before = problem.values(alpha, w), w.copy(), alpha.copy()
            draw = np.random.default_rng((number, int(part["task"].iloc[0])))
            problem.ascend(alpha, moved, draw.permutation(len(part)), scale=float(tasks))
            out = part.assign(alpha=alpha, step=None).reset_index(drop=True)
            out.at[0, "step"] = np.concatenate((problem.x.T @ (alpha - before), sums)).tobytes()
            return out

        return step

    for i in range(MAX_ROUNDS if n else 0):
        start = spark.sparkContext.broadcast((w, i))
        done = materialise(rows.groupBy("task").applyInPandas(
            climb(start), f"{schema}, alpha double, task int, step binary"), "dual-round")
        total = sum(np.frombuffer(r["step"]) for r in
                    done.filter("step IS NOT NULL").select("step").collect())
        # The sums belong to the weights before this round's step.
        left = _gap(total[-2:], w)
        if left <= gap:
            break
        w, rows = w + total[:-2], done.drop("step")
    return w, left


# -- classes --------------------------------------------------------------------------


def fit_sigmoid(margins: np.ndarray, positive: np.ndarray, weights: np.ndarray
                ) -> tuple[float, float]:
    """``a, b`` of the probability 1 / (1 + exp(a * margin + b)) of the positive class."""
    above, below = weights[positive].sum(), weights[~positive].sum()
    wanted = np.where(positive, (above + 1) / (above + 2), 1 / (below + 2))
    theta = np.array([0.0, np.log((below + 1) / (above + 1))])
    z = np.column_stack([margins, np.ones(len(margins))])

    def loss(t: np.ndarray) -> float:
        f = z @ t
        return float((weights * (np.logaddexp(0.0, f) - (1 - wanted) * f)).sum())

    now = loss(theta)
    for _ in range(100):
        p = 1 / (1 + np.exp(np.clip(z @ theta, -500, 500)))
        slope = z.T @ (weights * (wanted - p))
        curve = z.T @ (z * (weights * p * (1 - p))[:, None]) + 1e-10 * np.eye(2)
        step = -np.linalg.solve(curve, slope)
        size = 1.0
        while size > 1e-8 and loss(theta + size * step) > now:
            size /= 2
        theta = theta + size * step
        before, now = now, loss(theta)
        if before - now <= 1e-12 * max(abs(before), 1.0):
            break
    return float(theta[0]), float(theta[1])


def coupled(pairwise: np.ndarray) -> np.ndarray:
    """Class probabilities from ``pairwise[n, i, j]``, the probability of i against j."""
    n, k = pairwise.shape[:2]
    if k == 2:
        return pairwise[:, [0, 1], [1, 0]]
    q = -pairwise.transpose(0, 2, 1) * pairwise
    np.einsum("nii->ni", q)[:] = (pairwise.transpose(0, 2, 1) ** 2).sum(axis=2) - np.einsum(
        "nii->ni", pairwise.transpose(0, 2, 1) ** 2)
    # The least of p'Qp with shares that sum to 1.
    system = np.zeros((n, k + 1, k + 1))
    system[:, :k, :k] = q + 1e-12 * np.eye(k)
    system[:, :k, k] = system[:, k, :k] = 1.0
    right = np.zeros((n, k + 1, 1))
    right[:, k] = 1.0
    p = np.maximum(np.linalg.solve(system, right)[:, :k, 0], 0.0)
    return p / p.sum(axis=1, keepdims=True)


@dataclass
class PairModel:
    """Weights and sigmoids of all pairs of classes, in the order of ``pairs``."""

    settings: Settings
    classes: int
    weights: np.ndarray
    sigmoids: np.ndarray
    gap: float = 0.0

    def pairs(self) -> list[tuple[int, int]]:
        return pairs_of(self.classes)

    def judge(self, lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class codes by votes of the pairs, and probabilities, from random features."""
        margins = np.column_stack([lifted, np.full(len(lifted), CONSTANT)]) @ self.weights.T
        votes = np.zeros((len(lifted), self.classes))
        pairwise = np.full((len(lifted), self.classes, self.classes), 0.5)
        for p, (i, j) in enumerate(self.pairs()):
            first = margins[:, p] > 0
            votes[:, i] += first
            votes[:, j] += ~first
            a, b = self.sigmoids[p]
            share = 1 / (1 + np.exp(np.clip(a * margins[:, p] + b, -500, 500)))
            pairwise[:, i, j] = np.clip(share, 1e-7, 1 - 1e-7)
            pairwise[:, j, i] = 1 - pairwise[:, i, j]
        return votes.argmax(axis=1), coupled(pairwise)

    def stage(self, column: str) -> PairScore:
        return PairScore(inputCol=column, classes=self.classes,
                         weights=self.weights.ravel().tolist(),
                         sigmoids=self.sigmoids.ravel().tolist())


def pairs_of(classes: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(classes) for j in range(i + 1, classes)]


class PairScore(Transformer, HasInputCol, HasPredictionCol, DefaultParamsReadable,
                DefaultParamsWritable):
    """Adds the class code with most votes and ``_probability``."""

    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "of all pairs", TypeConverters.toListFloat)
    sigmoids = Param(Params._dummy(), "sigmoids", "of all pairs", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, predictionCol="prediction", classes=2, weights=None,
                 sigmoids=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def judge(self):
        """What finds class codes and probabilities from an array of vectors."""
        k = self.getOrDefault(self.classes)
        sigmoids = np.array(self.getOrDefault(self.sigmoids)).reshape(-1, 2)
        weights = np.array(self.getOrDefault(self.weights)).reshape(len(sigmoids), -1)
        return PairModel(None, k, weights, sigmoids).judge

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return _judged(dataset, self.getInputCol(), self, lambda x: x)


def _judged(dataset: DataFrame, column: str, scorer: LinearScore | PairScore, lift_of) -> DataFrame:
    """The prediction, and ``_probability`` of classes, of the lifted vectors of a column."""
    judge, classes = scorer.judge(), isinstance(scorer, PairScore)

    @F.pandas_udf("prediction double" + (", shares array<double>" if classes else ""))
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            found, shares = np.zeros(0), np.zeros((0, 1))
            if len(vectors):
                found, shares = judge(lift_of(np.stack(vectors.to_numpy())))
            out = pd.DataFrame({"prediction": np.asarray(found, float)})
            yield out.assign(shares=list(shares)) if classes else out

    judged = dataset.withColumn("_judged", apply(vector_to_array(F.col(column))))
    names = {scorer.getPredictionCol(): F.col("_judged.prediction")}
    if classes:
        names["_probability"] = F.col("_judged.shares")
    return judged.withColumns(names).drop("_judged")


def score_lifted(dataset: DataFrame, features: RandomFourierFeatures,
                 scorer: LinearScore | PairScore) -> DataFrame:
    """As both stages one after the other, whose random features stay in the task."""
    return _judged(dataset, features.getInputCol(), scorer, features.lift())


def _bucket(row: np.ndarray) -> np.ndarray:
    """Which of the folds inside a fit holds a row out."""
    return (scramble(row) % np.uint64(SIGMOID_FOLDS)).astype(int)


def classify_all(table: Table, fits: dict[int, tuple[frozenset, frozenset | None, Settings]],
                 gap: float = GAP) -> tuple[dict[int, PairModel], dict[int, float]]:
    """The classifier of every fit, and the accuracy on the parts that it scores."""
    size = max(how.size for _, _, how in fits.values())
    pairs = pairs_of(table.classes)
    if _fits_a_task(table, size):
        found = _pairs_in_tasks(table, fits, pairs, gap)
    else:
        found = {(k, p): _pair_large(table, parts, how, pair, gap, scored is None)
                 for k, (parts, scored, how) in fits.items() for p, pair in enumerate(pairs)}
    models = {}
    for k, (_, _, how) in fits.items():
        own = [found[k, p] for p in range(len(pairs))]
        models[k] = PairModel(how, table.classes, np.array([o[0] for o in own]),
                              np.array([o[1] for o in own]), max((o[2] for o in own), default=0.0))
    scored = {k: v[1] for k, v in fits.items() if v[1] is not None}
    return models, _accuracies(table, models, scored)


def _pairs_in_tasks(table: Table, fits, pairs, gap: float) -> dict:
    """Weights, sigmoid and gap of every pair of every fit; a task solves one problem.

    Fits that are scored need no probabilities and so no sigmoids.
    """
    shared, spark = table.shared, table.frame.sparkSession
    units = [(k, p, b) for k in sorted(fits) for p in range(len(pairs))
             for b in range(-1, SIGMOID_FOLDS if fits[k][1] is None else 0)]

    def tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, groups = shared.value
        for batch in batches:
            for u in batch["id"]:
                k, p, b = units[u]
                parts, _, how = fits[k]
                w = rows.group_weights(Unit(k, 0, parts))
                at = np.flatnonzero((w > 0) & np.isin(groups.y, pairs[p]))
                x, y = how.features(groups.x[at]), np.where(groups.y[at] == pairs[p][0], 1.0, -1.0)
                cost, out = how.cost * w[at], _bucket(groups.row[at]) == b
                weights, left = solve(Problem(x[~out], y[~out], cost[~out], 0.0, True),
                                      gap if b < 0 else max(gap, SIGMOID_GAP))
                held = _margin_counts(x[out] @ weights, y[out] > 0, w[at][out])
                yield pd.DataFrame({"id": [u], "gap": [left], "weights": [weights.tobytes()],
                                    "held": [held.to_numpy(float).tobytes()]})

    dealt = spark.createDataFrame(
        [(u,) for u in range(len(units))], "id long").repartition(min(len(units), 1_000), "id")
    got = {units[r["id"]]: r for r in dealt.mapInPandas(
        tasks, "id long, gap double, weights binary, held binary").collect()}
    found = {}
    for k, p in {unit[:2] for unit in units}:
        held = [np.frombuffer(got[unit]["held"]).reshape(-1, 3)
                for unit in units if unit[:2] == (k, p) and unit[2] >= 0]
        sigmoid = (-1.0, 0.0)
        if held:
            margins, positive, n = np.concatenate(held).T
            sigmoid = fit_sigmoid(margins, positive > 0, n)
        main = got[k, p, -1]
        found[k, p] = (np.frombuffer(main["weights"]), sigmoid, main["gap"])
    return found


def _margin_counts(margins: np.ndarray, positive: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """Margins in steps of a thousandth with their counts: all that a sigmoid needs."""
    rounded = np.round(np.clip(margins, -50, 50), 3)
    return pd.DataFrame({"margin": rounded, "positive": positive, "n": n}).groupby(
        ["margin", "positive"], as_index=False)["n"].sum()


def _pair_large(table: Table, parts: frozenset, how: Settings, pair: tuple[int, int], gap: float,
                with_sigmoid: bool):
    """As ``_pairs_in_tasks``, for one pair, in rounds over the whole table."""
    inputs = table.inputs
    sign = F.when(F.col("label") == pair[0], 1.0).otherwise(-1.0)
    rows = table.frame.filter(F.col("_part").isin([*parts]) & F.col("label").isin(*pair)).select(
        *inputs, sign.alias("label"), "_count", "_hash")
    weights, left = _rounds(rows, inputs, how, True, gap)
    if not with_sigmoid:
        return weights, (-1.0, 0.0), left
    bucket = F.pmod(F.xxhash64("_hash"), F.lit(SIGMOID_FOLDS))
    inner = {b: _rounds(rows.filter(bucket != b), inputs, how, True, max(gap, SIGMOID_GAP))[0]
             for b in range(SIGMOID_FOLDS)}

    def margins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, out = how.features(batch[inputs].to_numpy(float)), batch["_bucket"].to_numpy()
            found = sum((x @ inner[b]) * (out == b) for b in inner)
            yield _margin_counts(
                found, batch["label"].to_numpy() > 0, batch["_count"].to_numpy(float))

    held = rows.withColumn("_bucket", bucket).mapInPandas(
        margins, "margin double, positive boolean, n double")
    counts = held.groupBy("margin", "positive").agg(F.sum("n").alias("n")).toPandas()
    sigmoid = fit_sigmoid(*(counts[c].to_numpy() for c in ("margin", "positive", "n")))
    return weights, sigmoid, left


def _accuracies(table: Table, models: dict[int, PairModel], scored: dict[int, frozenset]
                ) -> dict[int, float]:
    """The weighted share of rows that each model names right, from one pass."""
    if not scored:
        return {}
    inputs = table.inputs

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = Rows.of(batch, inputs)
            for k, parts in scored.items():
                at = np.isin(rows.part, list(parts))
                if not at.any():
                    continue
                x = models[k].settings.features(rows.x[at])[:, :-1]
                right = models[k].judge(x)[0] == rows.y[at]
                yield pd.DataFrame({"fit": [k], "hits": [float(rows.count[at][right].sum())],
                                    "n": [float(rows.count[at].sum())]})

    sums = table.frame.mapInPandas(judge, "fit long, hits double, n double").groupBy("fit").agg(
        (F.sum("hits") / F.sum("n")).alias("score"))
    return {r["fit"]: r["score"] for r in sums.collect()}
