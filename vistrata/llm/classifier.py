"""Quality classifier: a factorisation machine over hashed words and text statistics.

The score is ``w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``, and the pair sum is
computed in linear time as ``(|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2``. Features are
the hashed distinct words of a text and a few statistics of its structure and size.
The machine is fitted on a bounded sample of labelled rows by AdaGrad on the logistic
loss; every text is then scored, in tasks, by array operations over whole batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vistrata.llm.tables import quoted
from vistrata.llm.wordhash import WordHasher, as_bytes, windows

WORD_BUCKETS = 1 << 14
RANK = 8
# Bound on the labelled rows to fit on; a larger set is thinned by the hash of the id.
TRAIN_ROWS = 12_000
HOLD_OUT, HELD = 4, 2
THRESHOLD = 0.7
EPOCHS, BATCH, RATE, DECAY = 8, 128, 0.15, 1e-5
# Words of the weight that all words of a text have together, next to the statistics.
WORD_WEIGHT = 0.5
SYMBOLS = b"#*$%&|<>"
STATISTICS = ["words", "chars", "word_length", "symbols", "digits", "capitals", "marks",
              "lines", "repeated_lines", "distinct_words", "repeated_runs", "other_bytes"]
# Texts of a batch that are worked on at once, by bytes.
GROUP_BYTES = 4 << 20


def _classes() -> np.ndarray:
    """Per byte, a column for each counted class."""
    table = np.zeros((256, 5), np.float32)
    table[list(SYMBOLS), 0] = 1
    table[48:58, 1] = 1
    table[65:91, 2] = 1
    table[list(b".,;:!?\"'()-"), 3] = 1
    table[128:, 4] = 1
    return table


class Features:
    """Sparse word features and dense statistics of texts."""

    def __init__(self):
        self.hasher = WordHasher(seed=7)
        self.classes = _classes()

    def statistics(self, data: list[bytes], hashes, counts) -> np.ndarray:
        n = len(data)
        owner = np.repeat(np.arange(n), counts)
        words = np.maximum(counts, 1)
        byte_counts = np.zeros((n, 5))
        for i, text in enumerate(data):
            if text:
                seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
                byte_counts[i] = seen @ self.classes
        sizes = np.array([len(t) for t in data], float)
        full = np.maximum(sizes, 1)
        lines = [[line for line in t.split(b"\n") if line.strip()] for t in data]
        n_lines = np.array([len(x) for x in lines], float)
        distinct_lines = np.array([len(set(x)) for x in lines], float)
        pairs = np.unique(np.stack((owner.astype(np.uint64), hashes), 1), axis=0) \
            if len(hashes) else np.zeros((0, 2), np.uint64)
        distinct = np.bincount(pairs[:, 0].astype(int), minlength=n)
        runs, n_runs = windows(hashes, counts, 3)
        run_owner = np.repeat(np.arange(n), n_runs)
        order = np.lexsort((runs, run_owner))
        same = np.zeros(len(runs), bool)
        if len(runs) > 1:
            r, o = runs[order], run_owner[order]
            twin = (r[1:] == r[:-1]) & (o[1:] == o[:-1])
            same[1:] |= twin
            same[:-1] |= twin
        repeated = np.bincount(run_owner[order][same], minlength=n)
        return np.stack((
            np.log1p(counts) / 4, np.log1p(sizes) / 6, np.minimum(sizes / words / 8, 3),
            np.minimum(byte_counts[:, 0] / words * 2, 3), byte_counts[:, 1] / full * 8,
            byte_counts[:, 2] / full * 4, byte_counts[:, 3] / full * 8, np.log1p(n_lines) / 3,
            1 - distinct_lines / np.maximum(n_lines, 1), distinct / words,
            repeated / np.maximum(n_runs, 1), byte_counts[:, 4] / full * 4), 1)

    def of(self, texts: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per group of texts: word buckets, their number per text, statistics."""
        data, low = as_bytes(texts), 0
        while low < len(data):
            high, size = low, 0
            while high < len(data) and (high == low or size + len(data[high]) <= GROUP_BYTES):
                size += len(data[high])
                high += 1
            group = data[low:high]
            hashes, counts = self.hasher.of_texts(group)
            owner = np.repeat(np.arange(len(group)), counts)
            bucket = (hashes >> np.uint64(50)).astype(np.int64) % WORD_BUCKETS
            cells = np.unique(owner * WORD_BUCKETS + bucket)
            n_words = np.bincount(cells // WORD_BUCKETS, minlength=len(group))
            yield cells % WORD_BUCKETS, n_words, self.statistics(group, hashes, counts)
            low = high


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows, runs of no rows included."""
    out = np.zeros((len(counts), *values.shape[1:]), values.dtype)
    some = counts > 0
    if some.any():
        first = np.cumsum(counts) - counts
        out[some] = np.add.reduceat(values, first[some], axis=0)
    return out


class Machine:
    """Weights of the words, then of the statistics, in one numbering."""

    def __init__(self):
        n, made = WORD_BUCKETS + len(STATISTICS), np.random.default_rng(1)
        self.w0 = 0.0
        self.w = np.zeros(n, np.float32)
        self.v = (made.standard_normal((n, RANK)) * 0.05).astype(np.float32)

    @staticmethod
    def _word_values(counts: np.ndarray) -> np.ndarray:
        return np.repeat(WORD_WEIGHT / np.sqrt(np.maximum(counts, 1)), counts).astype(np.float32)

    def scores(self, buckets, counts, stats) -> np.ndarray:
        x = self._word_values(counts)
        vx = self.v[buckets] * x[:, None]
        vs = self.v[WORD_BUCKETS:]
        total = _sums(vx, counts) + stats @ vs
        squares = _sums((vx * vx).sum(1), counts) + (stats ** 2) @ (vs * vs).sum(1)
        linear = _sums(self.w[buckets] * x, counts) + stats @ self.w[WORD_BUCKETS:]
        z = self.w0 + linear + ((total ** 2).sum(1) - squares) / 2
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, buckets, counts, stats, labels) -> None:
        first = np.cumsum(counts) - counts
        g0, gw, gv = 1e-6, np.full(len(self.w), 1e-6), np.full(self.v.shape, 1e-6)
        order = np.random.default_rng(2)
        own = np.arange(len(STATISTICS)) + WORD_BUCKETS
        for _ in range(EPOCHS if len(labels) else 0):
            for part in np.array_split(order.permutation(len(labels)),
                                       max(1, len(labels) // BATCH)):
                n = counts[part]
                at = np.repeat(first[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                b, s = buckets[at], stats[part]
                x = self._word_values(n)
                vx = self.v[b] * x[:, None]
                total = _sums(vx, n) + s @ self.v[own]
                error = (self.scores(b, n, s) - labels[part]) / len(part)
                row = np.repeat(np.arange(len(part)), n)
                e = error[row] * x
                ids, back = np.unique(b, return_inverse=True)
                dw = np.bincount(back, e, len(ids)) + DECAY * self.w[ids]
                dv = np.stack([np.bincount(back, e * (total[row, f] - vx[:, f]), len(ids))
                               for f in range(RANK)], 1) + DECAY * self.v[ids]
                ds = error @ s + DECAY * self.w[own]
                dvs = (s * error[:, None]).T @ total - ((s ** 2) * error[:, None]).sum(0)[
                    :, None] * self.v[own] + DECAY * self.v[own]
                ids = np.concatenate((ids, own))
                dw, dv = np.concatenate((dw, ds)), np.concatenate((dv, dvs))
                d0 = error.sum()
                g0 += d0 * d0
                gw[ids] += dw * dw
                gv[ids] += dv * dv
                self.w0 -= RATE * d0 / np.sqrt(g0)
                self.w[ids] -= RATE * dw / np.sqrt(gw[ids])
                self.v[ids] -= RATE / 2 * dv / np.sqrt(gv[ids])


def learning_rows(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id",
                  label_column: str = "quality", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, label`` of at most about ``train_rows`` labelled documents.

    A document with several labels counts as 1 only if all are 1; labels without
    a document may be among them.
    """
    rows = (
        labels.select(quoted(id_column).alias("doc_id"), quoted(label_column).alias("label"))
        .dropna().groupBy("doc_id").agg(F.min("label").cast("double").alias("label")))
    n = rows.count()
    if n > train_rows:
        part = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000))
        rows = rows.filter(part < F.lit(1_000_000 * train_rows // n))
    return rows


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id",
        text_column: str = "text", train_rows: int = TRAIN_ROWS) -> Machine:
    """Features are computed in tasks; the driver fits on the bounded sample of them."""
    sample = F.broadcast(learning_rows(docs, labels, id_column, train_rows=train_rows))
    rows = docs.select(quoted(id_column).alias("doc_id"), quoted(text_column).alias("text")).join(
        sample, "doc_id").select("doc_id", "text", "label")

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for batch in batches:
            low = 0
            for buckets, counts, stats in features.of(list(batch["text"])):
                cuts = np.cumsum(counts)[:-1]
                part = batch.iloc[low:low + len(counts)]
                low += len(counts)
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].to_numpy(), "label": part["label"].to_numpy(),
                    "buckets": [b.astype("<u2").tobytes() for b in np.split(buckets, cuts)],
                    "stats": list(stats)})

    sampled = rows.mapInPandas(
        describe, "doc_id long, label double, buckets binary, stats array<double>"
    ).toPandas().sort_values(["doc_id", "label"], kind="stable")
    machine = Machine()
    if len(sampled):
        buckets = [np.frombuffer(b, "<u2").astype(np.int64) for b in sampled["buckets"]]
        machine.fit(np.concatenate(buckets), np.array([len(b) for b in buckets]),
                    np.stack(sampled["stats"].to_numpy()), sampled["label"].to_numpy())
    return machine


def score(docs: DataFrame, machine: Machine, id_column: str = "doc_id",
          text_column: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every row; NULL texts are scored as empty ones."""
    weights = (machine.w0, machine.w, machine.v)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, features = Machine(), Features()
        own.w0, own.w, own.v = weights
        for batch in batches:
            found = [own.scores(*group) for group in features.of(list(batch["text"]))]
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "score": scores})

    rows = docs.select(quoted(id_column).cast("string").alias("doc_id"),
                       quoted(text_column).alias("text"))
    out = rows.mapInPandas(run, "doc_id string, score double")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(HOLD_OUT)) == HELD


def predict(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id",
            text_column: str = "text") -> DataFrame:
    """Learn from the labels of rows that are not held out, and score every row.

    Without labels every score is 0.5. Repeated rows are scored each; a row
    without an id counts as held out.
    """
    open_ = ~F.coalesce(held_out(quoted(id_column)), F.lit(True))
    machine = fit(docs.filter(open_), labels.filter(open_), id_column, text_column)
    out = score(docs, machine, id_column, text_column)
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
