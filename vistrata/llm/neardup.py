"""Near-duplicate documents by consistent weighted sampling of TF-IDF shingles.

A document is a weighted set of its runs of five words (A-Z lower-cased). The weight
of a run is its number of occurrences times the mean inverse document frequency of
its words; the frequency of the run itself would make rare edits weigh more than the
text that copies share, the more the more copies there are. Document frequencies are
counted over all documents in a fixed number of hashed counters.

Improved consistent weighted sampling (Ioffe, ICDM 2010) draws samples that agree with
a probability equal to the weighted Jaccard similarity. Bands of samples are bucketed;
documents that share a bucket are compared exactly. Equal texts are one node. In a
bucket all nodes are compared with the node that shares most buckets, then those that
are not yet connected with a few others, and last the nodes of different components
with each other, so no all-pairs step happens inside a group of copies. In crowded buckets,
of texts that share a passage, that last step takes the pairs that share a rare shingle,
which all similar pairs do. Classes are the connected components of the verified links.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vistrata.llm.components import components
from vistrata.llm.tables import BLOCKS, counter_blocks, join_groups, quoted, summed_blocks, unused
from vistrata.llm.wordhash import WordHasher, as_bytes, mixed, numbers, windows
from vistrata.plans.session import materialise

RUN_WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 10, 3
# In buckets above so many nodes, pairs are found by their rare shingles.
CROWD = 32
# Rounds in which the nodes of a bucket are compared with further nodes of it, so many a round.
ROUNDS, CENTRES = 2, 4
COUNTERS = 1 << 20
LEVELS = 1 << 16
GROUP_BYTES = 1 << 20
KNOWN_TEXTS = 64


def _gamma_levels() -> np.ndarray:
    """Quantiles of the gamma distribution with shape 2."""
    x = np.concatenate((np.geomspace(1e-5, 0.1, 20_000), np.linspace(0.1, 40, 80_000)[1:]))
    below = 1 - (1 + x) * np.exp(-x)
    return np.interp((np.arange(LEVELS) + 0.5) / LEVELS, below, x)


class Sampler:
    """Shingles, weights and samples of texts."""

    def __init__(self, idf: np.ndarray | None = None):
        self.hasher = WordHasher(seed=3)
        self.idf = idf
        gamma = _gamma_levels()
        self.r = gamma.astype(np.float32)
        self.log_c = np.log(gamma).astype(np.float32)
        self.seeds = numbers(BANDS * ROWS * 2, 11) | np.uint64(1)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.hasher.of_texts([t.lower() for t in texts])

    def weighted(self, hashes, counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shingles in order, their weights, and their number per text."""
        runs, n_runs = windows(hashes, counts, RUN_WORDS)
        owner = np.repeat(np.arange(len(counts)), n_runs)
        idf = self.idf[(hashes >> np.uint64(44)).astype(np.int64)]
        total = np.concatenate(([0.0], np.cumsum(idf, dtype=float)))
        first = np.cumsum(counts) - counts
        run_first = np.cumsum(n_runs) - n_runs
        at = np.repeat(first - run_first, n_runs) + np.arange(len(runs))
        size = np.repeat(np.minimum(counts, RUN_WORDS), n_runs)
        weight = (total[at + size] - total[at]) / np.maximum(size, 1)
        order = np.lexsort((runs, owner))
        runs, owner, weight = runs[order], owner[order], weight[order]
        new = np.ones(len(runs), bool)
        new[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(weight, starts) if len(starts) else weight
        return runs[starts], sums, np.bincount(owner[starts], minlength=len(counts))

    def bands(self, runs, weights, counts) -> np.ndarray:
        """Band keys, a row per text that has shingles."""
        first = (np.cumsum(counts) - counts)[counts > 0]
        log_w = np.log(weights).astype(np.float32)
        keys = np.zeros((len(first), BANDS), np.uint64)
        for k in range(BANDS * ROWS):
            z = runs * self.seeds[2 * k]
            z ^= z >> np.uint64(31)
            z *= self.seeds[2 * k + 1]
            r = self.r[(z >> np.uint64(48)).astype(np.int64)]
            log_c = self.log_c[((z >> np.uint64(32)) & np.uint64(LEVELS - 1)).astype(np.int64)]
            beta = ((z >> np.uint64(16)) & np.uint64(LEVELS - 1)).astype(np.float32) / LEVELS
            t = np.floor(log_w / r + beta)
            log_a = log_c - r * (t - beta) - r
            place = np.clip((log_a.astype(float) + 64) * (1 << 25), 0, (1 << 32) - 1)
            name = (z + t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            name = (name * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)
            least = np.minimum.reduceat(place.astype(np.uint64) << np.uint64(32) | name, first)
            band = k // ROWS
            keys[:, band] = mixed(keys[:, band] + (least & np.uint64(0xFFFFFFFF))
                                  + np.uint64((k + 1) << 33))
        return keys

    def groups(self, texts: list) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
        """Bounded groups of the texts with their word hashes and word counts."""
        data, low = as_bytes(texts), 0
        while low < len(data):
            high, size = low, 0
            while high < len(data) and (high == low or size + len(data[high]) <= GROUP_BYTES):
                size += len(data[high])
                high += 1
            yield data[low:high], *self.words(data[low:high])
            low = high


def _digests(hashes: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """128-bit digest of the words of each text, None without words."""
    ends = np.cumsum(counts)
    return [hashlib.blake2b(hashes[e - n:e].tobytes(), digest_size=16).digest() if n else None
            for e, n in zip(ends, counts)]


def document_frequencies(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """Inverse document frequencies of words by hashed counter, over all documents.

    The table has ``COUNTERS`` numbers whatever the size of the corpus; words that
    share a counter share their frequency.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler, found, n_docs = Sampler(), np.zeros(COUNTERS, np.int64), 0
        for batch in batches:
            for _, hashes, counts in sampler.groups(list(batch["text"])):
                owner = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
                cells = np.unique(owner << 20 | (hashes >> np.uint64(44)).astype(np.int64))
                found += np.bincount(cells & (COUNTERS - 1), minlength=COUNTERS)
                n_docs += int((counts > 0).sum())
        yield counter_blocks("words", found)
        yield counter_blocks("texts", np.array([n_docs]))

    rows = docs.select(quoted(text_column).alias("text")).mapInPandas(count, BLOCKS)
    seen = summed_blocks(rows, COUNTERS)
    total = seen["texts"][0] if "texts" in seen else 0
    return (1 + np.log((total + 1) / (seen.get("words", np.zeros(COUNTERS)) + 1))).astype(
        np.float32)


def signatures(docs: DataFrame, idf, id_column: str, text_column: str) -> DataFrame:
    """``doc_id, fp, bands``; both NULL for texts without words."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = Sampler(idf.value)
        for batch in batches:
            fps, bands = [], []
            for _, hashes, counts in sampler.groups(list(batch["text"])):
                fps += _digests(hashes, counts)
                keys = iter(sampler.bands(*sampler.weighted(hashes, counts)).view(np.int64))
                bands += [next(keys) if n else None for n in counts]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fps, "bands": bands})

    rows = docs.select(quoted(id_column).cast("string").alias("doc_id"),
                       quoted(text_column).alias("text"))
    out = rows.mapInPandas(run, "doc_id string, fp binary, bands array<long>")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _with_digest(docs: DataFrame, text_column: str, name: str) -> DataFrame:
    @F.pandas_udf("binary")
    def digest(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sampler = Sampler()
        for part in texts:
            fps: list = []
            for _, hashes, counts in sampler.groups(list(part)):
                fps += _digests(hashes, counts)
            yield pd.Series(fps, dtype=object)

    return docs.withColumn(name, digest(quoted(text_column)))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (sorted shingles, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def verified(pairs: DataFrame, texts: DataFrame, idf, least: float) -> DataFrame:
    """The pairs ``a, b`` whose weighted Jaccard similarity is at least ``least``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler, known = Sampler(idf.value), OrderedDict()

        def vector(fp: bytes, text: str):
            if fp not in known:
                data = as_bytes([text])
                known[fp] = sampler.weighted(*sampler.words(data))[:2]
                if len(known) > KNOWN_TEXTS:
                    known.popitem(last=False)
            else:
                known.move_to_end(fp)
            return known[fp]

        for batch in batches:
            values = [similarity(vector(a, ta), vector(b, tb)) for a, b, ta, tb in zip(
                batch["a"], batch["b"], batch["text_a"], batch["text_b"])]
            out = batch[["a", "b"]].assign(similarity=np.array(values, float))
            yield out[out["similarity"] >= least]

    of_b = texts.select(F.col("fp").alias("b"), F.col("text").alias("text_b"))
    of_a = texts.select(F.col("fp").alias("a"), F.col("text").alias("text_a"))
    rows = pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "text_a", "text_b")
    return rows.mapInPandas(run, "a binary, b binary, similarity double")


def _open_buckets(buckets: DataFrame, links: DataFrame) -> DataFrame:
    """``band, fp, label, size`` of the buckets with nodes of several components."""
    found = components(links)
    members = materialise(
        buckets.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
            "band", "fp", F.coalesce("root", "fp").alias("label")), "members")
    several = members.groupBy("band").agg(
        F.min("label").alias("low"), F.max("label").alias("high"),
        F.count(F.lit(1)).alias("size")).filter("low != high")
    return materialise(members.join(several.select("band", "size"), "band"), "open")


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _with_centres(open_: DataFrame, turn: int) -> DataFrame:
    """Each node of a bucket with a few nodes of it that belong to other components."""
    picks = [F.min(F.struct(F.xxhash64("fp", F.lit(turn * CENTRES + j)), F.col("fp").alias("c"),
                            F.col("label").alias("label_c")))
             for j in range(CENTRES)]
    centres = open_.groupBy("band").agg(F.array_distinct(F.array(*picks)).alias("picks")).select(
        "band", F.explode("picks").alias("x")).select("band", "x.c", "x.label_c")
    return open_.join(centres, "band").filter("label != label_c").select(*_pair("fp", "c"))


def _across(open_: DataFrame, texts: DataFrame, idf, similar: float) -> DataFrame:
    """Nodes of different components that share a bucket and, in a crowded one, a rare shingle.

    Two texts of weighted Jaccard similarity ``s`` share at least ``s`` of the weight
    of each. With the shingles of all texts in one order, the first that two such
    texts share is therefore among those that begin each of them up to ``1 - s`` of its
    weight. In the order of frequency these hold no shingle of a passage that many
    texts share, unless a text has little else; no pair is lost.
    """
    def cross(rows: DataFrame) -> DataFrame:
        """What two texts share from their first shared run on is no more than either's rest."""
        other = rows.select("band", *[F.col(c).alias(f"{c}_o")
                                      for c in ("fp", "label", "rest", "total")])
        enough = F.least("rest", "rest_o") >= (F.col("total") + F.col("total_o")) * F.lit(
            similar / (1 + similar) * (1 - 1e-9))
        return rows.join(other, "band").filter((F.col("label") < F.col("label_o")) & enough).select(
            *_pair("fp", "fp_o"))

    def each(sampler: Sampler, batch: pd.DataFrame):
        for _, hashes, counts in sampler.groups(list(batch["text"])):
            runs, weights, sizes = sampler.weighted(hashes, counts)
            ends = np.cumsum(sizes)
            for low, high in zip(ends - sizes, ends):
                yield runs[low:high], weights[low:high]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler, found = Sampler(idf.value), np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for runs, _ in each(sampler, batch):
                np.add.at(found, (runs >> np.uint64(44)).astype(np.int64), 1)
        yield counter_blocks("runs", found)

    crowded = open_.filter(F.col("size") > CROWD).select("fp", "label").distinct()
    source = materialise(
        crowded.join(texts, "fp").select("fp", "label", "text"), "crowded-texts")
    seen = summed_blocks(source.mapInPandas(count, BLOCKS), COUNTERS).get(
        "runs", np.zeros(COUNTERS))
    frequency = source.sparkSession.sparkContext.broadcast(seen.astype(np.float32))  # 4 MB

    def rare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler, often = Sampler(idf.value), frequency.value
        for batch in batches:
            kept, rests, totals = [], [], []
            for runs, weights in each(sampler, batch):
                own = often[(runs >> np.uint64(44)).astype(np.int64)]
                order = np.lexsort((runs, own))
                before = np.cumsum(weights[order]) - weights[order]
                first = order[before <= (1 - similar) * weights.sum() * (1 + 1e-9)]
                met = own[first] > 1
                kept.append(runs[first[met]].view(np.int64))
                rests.append((weights.sum() - before[:len(first)])[met])
                totals.append(weights.sum())
            yield batch[["fp", "label"]].assign(bands=kept, rests=rests, total=totals)

    found = source.mapInPandas(
        rare, "fp binary, label binary, bands array<long>, rests array<double>, total double")
    found = materialise(found.select(
        "fp", "label", "total", F.explode(F.arrays_zip("bands", "rests")).alias("x")).select(
        "fp", "label", "total", F.col("x.bands").alias("band"), F.col("x.rests").alias("rest")),
        "rare")
    shared = found.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    shared = shared.filter("low != high").select("band")
    small = open_.filter(F.col("size") <= CROWD).select(
        "fp", "label", "band", F.lit(1.0).alias("rest"), F.lit(0.0).alias("total"))
    return cross(small).unionByName(cross(found.join(shared, "band").select(*small.columns)))


def classify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
             similar: float = SIMILAR) -> DataFrame:
    """``doc_id, fp, n, class_id, class_size, n_links, keep_fp`` by id and text.

    ``n`` counts the rows with this id and text, ``n_links`` the tested links that
    end in this text. Texts already in one class are not compared again, so this is
    not the number of similar texts. ``class_id`` is the least id of the class; the
    row that stays has it and, among equal ids, the text digest ``keep_fp``. A
    text without words (NULL, empty, blank) is a class of its own id.
    """
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(document_frequencies(docs, text_column))  # 4 MB
    sigs = materialise(signatures(docs, idf, id_column, text_column), "signatures")
    worded = sigs.filter(F.col("fp").isNotNull())
    nodes = materialise(worded.groupBy("fp").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_rows"),
        F.first("bands").alias("bands")), "nodes")

    exploded = nodes.select("fp", F.explode("bands").alias("band"))
    crowded = materialise(
        exploded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"),
        "crowded")
    n_members = nodes.count() * BANDS
    members = materialise(
        join_groups(exploded, crowded, "band", F.col("size"), n_members), "members")
    # What copies were made from shares more buckets with them than they do with each other.
    known = members.groupBy("fp").agg(F.sum("size").alias("known"))
    centres = members.join(known, "fp").groupBy("band", "size").agg(
        F.max(F.struct("known", "fp"))["fp"].alias("a"))
    buckets = materialise(
        join_groups(members.drop("size"), materialise(centres, "centres"), "band",
                    F.col("size"), n_members).select("band", "fp", "a"), "buckets")
    first = materialise(
        buckets.filter("a != fp")
        .select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b")).distinct(),
        "pairs")
    wanted = buckets.select("fp").distinct().join(
        nodes.select("fp", F.col("rep").alias("doc_id")), "fp")
    texts = docs.select(quoted(id_column).cast("long").alias("id"),
                        quoted(text_column).alias("text"))
    texts = texts.join(wanted, F.col("id").eqNullSafe(F.col("doc_id"))).select("fp", "text")
    # An id may come with several texts: only the text with the digest is meant.
    texts = _with_digest(texts, "text", "own").filter("own = fp").drop("own")
    texts = materialise(texts.dropDuplicates(["fp"]) if _ids_repeat(sigs) else texts, "texts")

    links = materialise(verified(first, texts, idf, similar), "links")
    tested = first
    buckets = buckets.select("band", "fp")
    for turn in range(ROUNDS + 1):
        open_ = _open_buckets(buckets, links)
        if turn < ROUNDS:
            pairs = _with_centres(open_, turn)
        else:
            pairs = _across(open_, texts, idf, similar)
        pairs = materialise(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        more = materialise(verified(pairs, texts, idf, similar), "links")
        links, tested = links.unionByName(more), tested.unionByName(pairs)
    all_links = links
    roots = components(all_links)
    ends = all_links.select(F.col("a").alias("fp")).unionByName(
        all_links.select(F.col("b").alias("fp"))).groupBy("fp").agg(
        F.count(F.lit(1)).alias("n_links"))
    linked = materialise(
        nodes.select("fp", "rep", "n_rows").join(ends, "fp").join(
            roots.withColumnRenamed("node", "fp"), "fp", "left")
        .withColumn("root", F.coalesce("root", "fp")), "linked")
    summary = linked.groupBy("root").agg(
        F.min("rep").alias("class_id"), F.sum("n_rows").alias("class_size"),
        F.min(F.struct(F.col("rep").isNull(), "rep", "fp"))["fp"].alias("keep_fp"))
    classes = linked.join(summary, "root").select(
        "fp", "n_rows", "n_links", "class_id", "class_size", "keep_fp")
    alone = nodes.join(linked.select("fp"), "fp", "left_anti").select(
        "fp", "n_rows", F.lit(0).cast("long").alias("n_links"), F.col("rep").alias("class_id"),
        F.col("n_rows").alias("class_size"), F.col("fp").alias("keep_fp"))
    table = materialise(classes.unionByName(alone), "classes")
    counted = materialise(
        worded.groupBy("doc_id", "fp").agg(F.count(F.lit(1)).alias("n")), "rows")
    rows = join_groups(counted, table, "fp", F.col("n_rows"), counted.count())
    wordless = sigs.filter(F.col("fp").isNull()).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"))
    return rows.select(
        "doc_id", "fp", "n", "class_id", "class_size", "n_links", "keep_fp"
    ).unionByName(wordless.select(
        "doc_id", F.lit(None).cast("binary").alias("fp"), "n", F.col("doc_id").alias("class_id"),
        F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"),
        F.lit(None).cast("binary").alias("keep_fp")))


def _ids_repeat(sigs: DataFrame) -> bool:
    return bool(sigs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").take(1))


def _stays() -> Column:
    return F.col("fp").isNull() | (
        (F.col("fp") == F.col("keep_fp")) & F.col("doc_id").eqNullSafe(F.col("class_id")))


def near_duplicates(docs: DataFrame, **columns) -> DataFrame:
    """``doc_id, class_id, class_size, n_links, kept``, a row for every row of ``docs``.

    Of each class one row is kept, that with the least id; texts without words are
    all kept. Of rows equal in id and words the first is kept. An empty table
    gives no rows; other columns are not looked at. ``n_links`` counts the links that
    were tested, as in ``classify``.
    """
    rows = classify(docs, **columns)
    each = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    kept = _stays() & ((F.col("copy") == 1) | F.col("fp").isNull())
    return each.select("doc_id", "class_id", "class_size", "n_links", kept.alias("kept"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options
             ) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns.

    Only the few rows that go, or that repeat, are joined with the documents.
    """
    rows = classify(docs, id_column=id_column, text_column=text_column, **options)
    fp, mark = unused(docs, "_fp"), unused(docs, "_goes")
    other = unused(docs, "_id")
    marks = materialise(
        rows.filter(F.col("fp").isNotNull() & (~_stays() | (F.col("n") > 1)))
        .select(F.col("doc_id").alias(other), F.col("fp").alias(f"{fp}2"),
                (~_stays()).alias(mark)), "marks")
    named = _with_digest(docs, text_column, fp)
    same = quoted(id_column).cast("long").eqNullSafe(F.col(other)) & (
        F.col(fp) == F.col(f"{fp}2"))
    met = named.join(marks, same, "left")
    kept = met.filter(F.col(mark).isNull())
    if marks.filter(~F.col(mark)).take(1):
        repeated = met.filter(~F.col(mark)).dropDuplicates([other, fp])
        kept = kept.unionByName(repeated)
    return kept.select(*[quoted(c) for c in docs.columns])
