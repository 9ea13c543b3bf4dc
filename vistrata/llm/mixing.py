"""Mix sources to target weights by hash thresholds.

Every document has a hash of its id. Per source the mix takes whole passes over
the source plus the documents whose hash lies below a threshold. The threshold
comes from nested histograms: words are summed by source and hash bucket (combined
before the shuffle), the bucket in which the budget ends is the boundary, and only
the rows of the boundary buckets are summed again by the next bits. Nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vistrata.llm.tables import quoted, unused, words
from vistrata.operators.ordered import running_totals
from vistrata.plans.session import materialise

# Fixed weights of the sources by code point, repeating, and the most passes over a source.
WEIGHTS = [5, 2, 1]
MAX_PASSES = 3
# 60 bits of hash, refined by 12 bits a level.
HASH_DIGITS = 15
LEVEL_BITS = 12
LEVELS = 5


def id_hash(doc_id: Column) -> Column:
    """The first 60 bits of the MD5 of the id as text; NULL counts as empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("long")


def text_size(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_passes: float = MAX_PASSES
                   ) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources by code point, NULL last, get the weights in turn and share all words.
    A target above ``max_passes`` times its source is cut to that, and the excess
    goes to the others by weight until none is above: all uncut targets are one
    level times their weight. Each round is one aggregate over the sources.
    """
    sizes = materialise(sizes, "source-sizes")
    named = sizes.filter(F.col("source").isNotNull()).withColumn("one", F.lit(1))
    n_named = named.count()
    ranked = running_totals(named, ["source"], ["one"], n_named).select(
        "source", "source_size", F.col("before_one").alias("place"))
    nameless = sizes.filter(F.col("source").isNull()).select(
        "source", "source_size", F.lit(n_named).cast("long").alias("place"))
    by_place = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                            (F.col("place") % len(weights) + 1).cast("int"))
    table = materialise(
        ranked.unionByName(nameless).withColumn("weight", by_place), "source-weights")
    limit = F.col("source_size") * float(max_passes)
    level, n_cut = 0.0, -1
    while True:
        cut = F.lit(level) * F.col("weight") > limit if n_cut >= 0 else F.lit(False)
        row = table.agg(
            F.sum("source_size").alias("all"), F.count(F.when(cut, 1)).alias("n"),
            F.sum(F.when(cut, limit).otherwise(0.0)).alias("held"),
            F.sum(F.when(~cut, F.col("weight"))).alias("weight")).first()
        if row["n"] == n_cut or not row["weight"]:
            break
        n_cut = row["n"]
        level = (row["all"] - row["held"]) / row["weight"]
    target = F.least(limit, F.lit(level) * F.col("weight")) if n_cut >= 0 else limit
    return table.select("source", "source_size", target.cast("double").alias("target"))


def _key(source: Column) -> list[Column]:
    return [source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("source_key")]


KEYS = ["no_source", "source_key"]


def thresholds(units: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: ``passes`` over all of it, the ``edge`` hash below which documents
    are taken once more, and ``edge_rows`` of the ``edge_n`` rows with the edge hash.

    ``units`` has ``no_source, source_key, h, size, n``: ``n`` rows of a hash and size.
    """
    size = F.col("source_size")
    passes = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)).cast("long")
    state = targets.select(*_key(F.col("source")), "source_size", "target",
                           passes.alias("passes"))
    state = state.withColumns({
        "rest": F.greatest(F.col("target") - F.col("passes") * size, F.lit(0.0)),
        "prefix": F.lit(0).cast("long")})
    state = materialise(state, "mix-state")
    for level in range(1, LEVELS + 1):
        shift = LEVEL_BITS * (LEVELS - level)
        open_rows = units.join(state.select(*KEYS, "prefix", "rest"), KEYS).filter(
            (F.col("rest") > 0)
            & (F.shiftright(F.col("h"), shift + LEVEL_BITS) == F.col("prefix")))
        histogram = open_rows.groupBy(*KEYS, F.shiftright("h", shift).alias("bucket")).agg(
            F.sum(F.col("size") * F.col("n")).alias("sum"))
        order = Window.partitionBy(*KEYS).orderBy("bucket")  # at most 2**LEVEL_BITS rows
        before = F.sum("sum").over(order) - F.col("sum")
        found = (
            histogram.withColumn("before", before)
            .join(state.select(*KEYS, "rest"), KEYS)
            .filter((F.col("before") < F.col("rest"))
                    & (F.col("rest") <= F.col("before") + F.col("sum")))
            .select(*KEYS, F.col("bucket"), (F.col("rest") - F.col("before")).alias("left")))
        state = materialise(
            state.join(found, KEYS, "left").select(
                *KEYS, "source_size", "target", "passes",
                F.coalesce("left", F.lit(0.0)).alias("rest"),
                F.coalesce("bucket", F.lit(0).cast("long")).alias("prefix")), "mix-state")
    edge = (
        units.join(state.select(*KEYS, "prefix"), KEYS).filter(F.col("h") == F.col("prefix"))
        .groupBy(*KEYS).agg(F.sum("n").alias("edge_n"),
                            F.sum(F.col("n") * F.col("size")).alias("edge_words")))
    taken = F.when(F.col("rest") > 0, F.least(
        F.col("edge_n"), F.round(F.col("rest") / F.col("edge_words") * F.col("edge_n"))
        .cast("long"))).otherwise(F.lit(0).cast("long"))
    return state.join(edge, KEYS, "left").select(
        *KEYS, "source_size", "target", "passes", F.col("prefix").alias("edge"),
        F.coalesce("edge_n", F.lit(0).cast("long")).alias("edge_n"),
        F.coalesce(taken, F.lit(0).cast("long")).alias("edge_rows"))


def plan_mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
             source_column: str = "source", weights=WEIGHTS, max_passes: float = MAX_PASSES
             ) -> tuple[DataFrame, DataFrame]:
    """The rows by id, source and size (``n`` alike), and the threshold table.

    NULL texts have size 0; rows equal in id, source and size are interchangeable.
    """
    units = materialise(
        docs.select(quoted(id_column).alias("doc_id"), *_key(quoted(source_column)),
                    text_size(quoted(text_column)).alias("size"))
        .groupBy("doc_id", *KEYS, "size").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("h", id_hash(F.col("doc_id"))), "mix-units")
    sizes = units.groupBy(*KEYS).agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).select(
        F.when(~F.col("no_source"), F.col("source_key")).alias("source"), "source_size")
    targets = source_targets(sizes, weights, max_passes)
    return units, materialise(thresholds(units, targets), "mix-thresholds")


def _copies(n: Column) -> Column:
    """Passes of ``n`` equal rows together; rows at the edge share theirs by number."""
    at_edge = F.round(F.col("edge_rows") * n / F.greatest(F.col("edge_n"), F.lit(1))).cast("long")
    more = F.when(F.col("h") < F.col("edge"), n).when(
        F.col("h") == F.col("edge"), F.least(n, at_edge)).otherwise(F.lit(0))
    return F.col("passes") * n + more


def taken_words(docs: DataFrame, **columns) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``."""
    units, plan = plan_mix(docs, **columns)
    rows = units.join(plan, KEYS).withColumn("total", _copies(F.col("n")))
    each = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    whole = F.floor(F.col("total") / F.col("n"))
    extra = (F.col("copy") <= F.col("total") - whole * F.col("n")).cast("long")
    return each.select("doc_id", "size", "source_size", "target",
                       (F.col("size") * (whole + extra)).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          source_column: str = "source", **weights) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; texts are not shuffled.

    Only rows with an edge hash are grouped, to give equal rows their share.
    """
    _, plan = plan_mix(docs, id_column, text_column, source_column, **weights)
    columns = [quoted(c) for c in docs.columns]
    row = unused(docs, "_row")
    keyed = docs.select(F.struct(*columns).alias(row), *_key(quoted(source_column)),
                        id_hash(quoted(id_column)).alias("h")).join(plan, KEYS)
    at_edge = (F.col("h") == F.col("edge")) & (F.col("edge_rows") > 0)
    inner = keyed.filter(~at_edge).withColumn("total", _copies(F.lit(1).cast("long")))
    edge = keyed.filter(at_edge).groupBy(row, "h", "edge", "edge_rows", "edge_n", "passes").agg(
        F.count(F.lit(1)).alias("n")).withColumn("total", _copies(F.col("n")))
    both = inner.select(row, "total").unionByName(edge.select(row, "total"))
    return both.filter("total > 0").withColumn(
        unused(docs, "_copy"), F.explode(F.sequence(F.lit(1), F.col("total").cast("int")))
    ).select(f"{row}.*")
