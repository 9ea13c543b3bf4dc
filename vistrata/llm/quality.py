"""Quality rules whose cutoffs are chosen under an exact bound on false rejections.

Each rule rejects texts with a feature above a cutoff. On labelled documents of a
stratum, ``k`` of ``n`` good ones (that pass the base rules) lie above a cutoff.
The cutoff is certified when the exact binomial tail ``P(X <= k | n, RISK)`` is at
most ``ERROR / (strata * features)``: then its rate of false rejections is below
``RISK``, with all statements of all strata holding together with confidence
``1 - ERROR``. Per stratum and feature the cutoffs are tested from loose to strict
and the first failure ends the sequence, so the grid needs no further correction
(fixed-sequence testing); strata and features are Bonferroni-corrected. Of the
certified cutoffs the one is taken that gains most: bad labelled documents rejected
less ``COST`` times good ones, the loosest among equals, none without a gain. A
stratum with too few labels certifies nothing and rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vistrata.llm.tables import SPACES, let, quoted, unused, words
from vistrata.plans.session import materialise

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Bound on the share of good documents that one rule rejects, and the chance of any violation.
RISK = 0.01
ERROR = 0.05
# A rejected good document outweighs so many rejected bad ones.
COST = 10
# Fixed grids, loose to strict; a text is rejected when its feature is above the cutoff.
GRIDS = {
    "symbols_per_word": [3.0, 2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1],
    "repeat_share": [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
    "word_length": [40.0, 30.0, 25.0, 20.0, 15.0, 12.0, 10.0],
}


def _repeat_words(w: Column) -> Column:
    """Words covered by 3-word windows that occur at least twice in the text."""
    def windows(ws: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(ws) - 2),
            lambda i: F.xxhash64(F.element_at(ws, i), F.element_at(ws, i + 1),
                                 F.element_at(ws, i + 2)))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(
            at, start,
            lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"),
                                  p.alias("last")))["n"]

    def repeated(h: Column) -> Column:
        pairs = F.array_sort(F.arrays_zip(h.alias("h"), F.sequence(F.lit(0), F.size(h) - 1)
                                          .alias("i")))
        return let(F.sort_array(pairs), lambda s: covered(F.sort_array(F.array_distinct(F.flatten(
            F.zip_with(
                F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1),
                lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(
                    F.array().cast("array<int>"))))))))

    def counted(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeated(h))

    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows(w), counted))


def features(text: Column) -> Column:
    """A struct of the base counts of a text; a NULL text has no words.

    Windows are told apart by a 64-bit hash of their three words within one text.
    """
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1),
                     lambda line: F.btrim(line, F.lit(SPACES)) != "")
    return let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, "[ \\x09-\\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", "")))
        .cast("long").alias("n_symbols"),
        let(lines, lambda ls: F.struct(
            F.size(ls).alias("n"),
            (F.size(ls) - F.size(F.array_distinct(ls))).alias("dup"))).alias("lines"),
        _repeat_words(w).cast("long").alias("n_repeat_words")))


def measured(docs: DataFrame, id_column: str, text_column: str, stratum_column: str
             ) -> DataFrame:
    """One row per document with its stratum, base counts and rule features."""
    found = features(quoted(text_column))
    rows = docs.select(quoted(id_column).alias("doc_id"),
                       quoted(stratum_column).cast("string").alias("stratum"), found.alias("f"))
    return with_features(rows, "f").drop("f")


def with_features(rows: DataFrame, f: str) -> DataFrame:
    n = F.greatest(F.col(f"{f}.n_words"), F.lit(1))
    return rows.withColumns({
        "n_words": F.col(f"{f}.n_words"),
        "word_chars": F.col(f"{f}.word_chars"),
        "n_symbols": F.col(f"{f}.n_symbols"),
        "n_dup_lines": F.col(f"{f}.lines.dup").cast("long"),
        "n_repeat_words": F.col(f"{f}.n_repeat_words"),
        "base_failed": (F.col(f"{f}.n_words") < MIN_WORDS)
        | (100 * F.col(f"{f}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{f}.n_words")),
        "symbols_per_word": F.col(f"{f}.n_symbols") / n,
        "dup_line_share": F.col(f"{f}.lines.dup") / F.greatest(F.col(f"{f}.lines.n"), F.lit(1)),
        "repeat_share": F.col(f"{f}.n_repeat_words") / n,
        "word_length": F.col(f"{f}.word_chars") / n,
    })


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """Exact ``P(X <= k)`` of a binomial, summed in logarithms; 1 where ``k >= n p``."""
    odds = F.lit(p / (1 - p))
    start = F.struct((n * F.log1p(F.lit(-p))).alias("term"), (n * F.log1p(F.lit(-p))).alias("sum"))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i * odds)
        high, low = F.greatest(s["sum"], term), F.least(s["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(
        F.array().cast("array<bigint>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(F.aggregate(steps, start, add)["sum"]))


def certified_cutoffs(measures: DataFrame, labels: DataFrame, risk: float = RISK,
                      error: float = ERROR) -> DataFrame:
    """``stratum`` and one cutoff per feature, NULL where no rule is taken.

    ``labels`` has ``doc_id`` and ``quality`` (1 good); a document is good when all
    its labels are. NULL strata are a stratum of their own.
    """
    good = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    )
    held = measures.filter(~F.col("base_failed")).join(good, "doc_id")
    sums = []
    for name, grid in GRIDS.items():
        for cut in grid:
            above = F.col(name) > cut
            sums += [F.count(F.when(above & F.col("good"), 1)).alias(f"g_{name}_{cut}"),
                     F.count(F.when(above & ~F.col("good"), 1)).alias(f"b_{name}_{cut}")]
    per = held.groupBy("stratum").agg(F.count(F.when(F.col("good"), 1)).alias("n_good"), *sums)
    rows = F.array(*[
        F.struct(F.lit(name).alias("feature"), F.lit(j).alias("place"), F.lit(cut).alias("cut"),
                 F.col(f"`g_{name}_{cut}`").alias("k"), F.col(f"`b_{name}_{cut}`").alias("bad"))
        for name, grid in GRIDS.items() for j, cut in enumerate(grid)])
    per = materialise(per, "rule-counts")
    tests = max(1, per.count()) * len(GRIDS)
    level = F.lit(error / tests)
    cells = per.select("stratum", "n_good", F.inline(rows))
    tested = cells.withColumn("passed", binomial_tail(F.col("k"), F.col("n_good"), risk) <= level)
    sequence = Window.partitionBy("stratum", "feature").orderBy("place")
    certified = tested.withColumn("passed", F.min("passed").over(sequence)).filter("passed")
    gain = F.col("bad") - COST * F.col("k")
    chosen = certified.filter(gain > 0).groupBy("stratum", "feature").agg(
        F.max_by("cut", F.struct(gain, -F.col("place"))).alias("cut"))
    return chosen.groupBy("stratum").agg(*[
        F.max(F.when(F.col("feature") == name, F.col("cut"))).alias(f"cut_{name}")
        for name in GRIDS])


def _accepted() -> Column:
    above = F.lit(False)
    for name in GRIDS:
        above = above | F.coalesce(F.col(name) > F.col(f"cut_{name}"), F.lit(False))
    return ~F.col("base_failed") & ~above


def _with_cutoffs(rows: DataFrame, cutoffs: DataFrame, stratum: Column) -> DataFrame:
    """NULL strata meet their own row: the join is on a pair that is never NULL."""
    cut = cutoffs.select(
        F.col("stratum").isNull().alias("_none"),
        F.coalesce("stratum", F.lit("")).alias("_stratum"),
        *[f"cut_{name}" for name in GRIDS])
    same = (stratum.isNull() == F.col("_none")) & (
        F.coalesce(stratum, F.lit("")) == F.col("_stratum"))
    return rows.join(cut, same, "left").drop("_none", "_stratum")


def judge(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id",
          text_column: str = "text", stratum_column: str = "lang") -> DataFrame:
    """Base counts and verdict of every row of ``docs``.

    NULL and empty texts have no words and fail the base rules. Repeated rows are
    judged each. Without labels only the base rules reject.
    """
    measures = materialise(
        measured(docs, id_column, text_column, stratum_column), "quality-features")
    cutoffs = materialise(certified_cutoffs(measures, labels), "cutoffs")
    return _with_cutoffs(measures, cutoffs, F.col("stratum")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", _accepted().alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id",
              text_column: str = "text", stratum_column: str = "lang") -> DataFrame:
    """The accepted rows of ``docs`` with their columns; texts are not shuffled.

    The features are computed once for the cutoffs and again for the verdict.
    """
    measures = materialise(
        measured(docs, id_column, text_column, stratum_column), "quality-features")
    cutoffs = materialise(certified_cutoffs(measures, labels), "cutoffs")
    held = unused(docs, "_row")
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias(held),
                       quoted(stratum_column).cast("string").alias("stratum"),
                       features(quoted(text_column)).alias("f"))
    judged = _with_cutoffs(with_features(rows, "f"), cutoffs, F.col("stratum"))
    return judged.filter(_accepted()).select(f"{held}.*")
