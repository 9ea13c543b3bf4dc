"""Languages of documents as mixtures, by expectation-maximisation.

Training counts, per language, the hashed letter trigrams of labelled documents. A
document is a mixture of languages over its words: the likelihood of a word in a
language is the product over its trigrams, and the proportions are estimated by
expectation-maximisation. The set of languages is selected backwards by penalised
likelihood (BIC): the language with the least share goes as long as that lowers it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vistrata.llm.tables import packed_counts, quoted

BUCKETS = 1 << 16
SMOOTHING = 0.1
UNKNOWN = "und"
HOLD_OUT = 5
ROUNDS, CLOSE = 40, 1e-4
BLOCK_CHARS = 1 << 20
# A language with less than so many words is dropped before the penalised search.
LEAST_WORDS = 0.5


class Trigrams:
    """Hashed trigrams around every letter of a text, and where words begin."""

    def __init__(self):
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(self.letter[codes], codes, 0)
        padded = np.concatenate(([0], codes, [0])).astype(np.uint64)
        at = np.flatnonzero(codes)
        mix = (padded[at] * np.uint64(0x9E3779B97F4A7C15)
               ^ padded[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F)
               ^ padded[at + 2] * np.uint64(0x165667B19E3779F9))
        mix ^= mix >> np.uint64(29)
        mix *= np.uint64(0xBF58476D1CE4E5B9)
        buckets = (mix >> np.uint64(40)).astype(np.int64) % BUCKETS
        return buckets, np.flatnonzero(padded[at] == 0)


def _parts(text: str) -> Iterator[str]:
    """A long text in blocks, cut after a space where there is one."""
    low = 0
    while low < len(text):
        high = low + BLOCK_CHARS
        if high < len(text):
            space = text.find(" ", high)
            high = len(text) if space < 0 else space + 1
        yield text[low:high]
        low = high


def count_trigrams(docs: DataFrame, text_column: str = "text", lang_column: str = "lang"
                   ) -> DataFrame:
    """Counts by language (``name``) and bucket, of all rows with a text and a language."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, found = Trigrams(), {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                for part in _parts(text):
                    buckets, _ = grams.of(part)
                    total = found.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    total += np.bincount(buckets, minlength=BUCKETS)
        for lang, total in found.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"name": lang, "counter": at, "n": total[at]})

    rows = docs.select(quoted(text_column).alias("text"),
                       quoted(lang_column).cast("string").alias("lang")).dropna()
    return rows.mapInPandas(count, "name string, counter long, n long")


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
        lang_column: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages by name, and the log-probabilities of the buckets in each.

    All labelled rows are counted; the result has a fixed number of buckets per
    language.
    """
    counts = packed_counts(count_trigrams(docs, text_column, lang_column), BUCKETS)
    langs = sorted(counts)
    table = np.full((BUCKETS, len(langs)), SMOOTHING)
    for i, lang in enumerate(langs):
        table[:, i] += counts[lang]
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def word_likelihoods(text: str, grams: Trigrams, logs: np.ndarray) -> np.ndarray:
    """One row per word: the logarithm of its likelihood in every language."""
    rows = []
    for part in _parts(text):
        buckets, starts = grams.of(part)
        if len(starts):
            rows.append(np.add.reduceat(logs[buckets], starts, axis=0))
    return np.concatenate(rows) if rows else np.zeros((0, logs.shape[1]), np.float32)


def proportions(odds: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Mixture shares by expectation-maximisation, and the log-likelihood they reach."""
    share = start / start.sum()
    for _ in range(ROUNDS):
        joint = odds * share
        new = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
        done = np.abs(new - share).max() < CLOSE
        share = new
        if done:
            break
    return share, float(np.log(odds @ share).sum())


def mixture(likelihoods: np.ndarray) -> np.ndarray:
    """Share of every language; 0 for those that the penalised likelihood leaves out."""
    n, n_langs = likelihoods.shape
    odds = np.exp((likelihoods - likelihoods.max(axis=1, keepdims=True)).astype(float))
    odds = np.maximum(odds, 1e-30)
    share, fit_ = proportions(odds, np.ones(n_langs))
    chosen = np.flatnonzero(share * n >= min(LEAST_WORDS, share.max() * n))
    if len(chosen) < n_langs:
        share, fit_ = proportions(odds[:, chosen], share[chosen])
    while len(chosen) > 1:
        keep = np.arange(len(chosen)) != share.argmin()
        fewer, less = proportions(odds[:, chosen[keep]], share[keep])
        if 2 * (fit_ - less) > np.log(n):
            break
        chosen, share, fit_ = chosen[keep], fewer, less
    out = np.zeros(n_langs)
    out[chosen] = share
    return out


def identify(docs: DataFrame, langs: list[str], logs: np.ndarray, id_column: str = "doc_id",
             text_column: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, languages`` of every row.

    ``score`` is the share of the predicted language, ``languages`` the selected
    set by share. Texts that are NULL or have no letter are ``und`` with score 0, as
    are all without a trained language. Equal shares go to the first name.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Trigrams()
        for batch in batches:
            names, scores, sets = [], [], []
            for text in batch["text"]:
                found = word_likelihoods(text if isinstance(text, str) else "", grams, logs) \
                    if langs else ()
                if not len(found):
                    names.append(UNKNOWN), scores.append(0.0), sets.append([])
                    continue
                share = mixture(found)
                names.append(langs[share.argmax()])
                scores.append(float(min(1.0, share.max())))
                sets.append([langs[i] for i in np.argsort(-share, kind="stable") if share[i] > 0])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": names, "score": scores,
                                "languages": sets})

    rows = docs.select(quoted(id_column).cast("string").alias("doc_id"),
                       quoted(text_column).alias("text"))
    out = rows.mapInPandas(
        run, "doc_id string, lang_pred string, score double, languages array<string>")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(HOLD_OUT)) == 0


def predict(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
            lang_column: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out and predict all rows."""
    learn = docs.filter(~F.coalesce(held_out(quoted(id_column)), F.lit(True)))
    langs, logs = fit(learn, id_column, text_column, lang_column)
    out = identify(docs, langs, logs, id_column, text_column)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(True))
                      .alias("held_out"), "lang_pred", "score", "languages")
