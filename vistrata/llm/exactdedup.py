"""Exact duplicates by a persistent digest index.

The index is a Parquet table with one row per distinct digest, bucketed and
sorted by digest. A batch is reduced to its distinct digests (combined before
the shuffle, so a hot text costs one row per task), anti-joined with the index
by sort-merge without shuffling the index, and what is new is appended.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vistrata.llm.tables import ascii_lower, join_groups, quoted, unused
from vistrata.plans.session import materialise, scratch_path


def text_digest(text: Column) -> Column:
    """SHA-256, in hex, of the text with A-Z lower-cased; NULL counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


class DigestIndex:
    """Digests seen so far, with the row that stays for each.

    ``folder`` is a shared folder; opening the same folder again, also from
    another session, continues the index. ``buckets`` must stay the same.
    """

    SCHEMA = "digest STRING, keep_id BIGINT, n_keep BIGINT, group_size BIGINT"

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = "digest_index_" + hashlib.md5(folder.encode()).hexdigest()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({self.SCHEMA}) USING parquet"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
            f" LOCATION '{folder}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> None:
        """Append the groups whose digest is not in the index yet."""
        known = self.table().select("digest")
        new = groups.join(known.hint("merge"), "digest", "left_anti")
        kept = materialise(new.select(*self.table().columns), "new-digests")
        kept.repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def count_rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``doc_id, digest, n``: the rows of each id and digest."""
    return docs.select(
        quoted(id_column).cast("long").alias("doc_id"),
        text_digest(quoted(text_column)).alias("digest"),
    ).groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))


def group_digests(counted: DataFrame) -> DataFrame:
    best = F.max(F.struct("doc_id", "n")).alias("best")
    return counted.groupBy("digest").agg(best, F.sum("n").alias("group_size")).select(
        "digest", F.col("best.doc_id").alias("keep_id"), F.col("best.n").alias("n_keep"),
        "group_size",
    )


def verdicts(docs: DataFrame, index: DigestIndex, id_column: str = "doc_id",
             text_column: str = "text") -> DataFrame:
    """Add a batch to the index and return a verdict for each of its rows.

    Columns ``doc_id, keep_id, group_size, kept, text_sha256``. Of equal texts of
    a batch the row with the largest id stays (an id beats NULL; of rows equal in
    id and text one stays), unless an earlier batch had the text. NULL texts count
    as empty. An empty batch gives no rows. ``group_size`` counts the batch the
    text came with first. Other columns of ``docs`` are not looked at.
    """
    counted = materialise(count_rows(docs, id_column, text_column), "digests")
    seen = index.table().select("digest", F.lit(True).alias("old"))
    before = materialise(
        counted.select("digest").distinct().join(seen.hint("merge"), "digest"), "old-digests")
    index.append(group_digests(counted))
    groups = index.table().join(before, "digest", "left")
    total = counted.count()
    rows = join_groups(counted, groups, "digest", F.col("group_size"), total)
    copy = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    first = (F.col("copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return copy.select(
        "doc_id", "keep_id", "group_size", (first & F.col("old").isNull()).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, index: DigestIndex, id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay (see ``verdicts``), with their columns.

    Only the digests are grouped; the texts are shuffled once, to meet the
    winners. Rows equal in id and text are reduced by an aggregate that combines
    before its shuffle.
    """
    key = unused(docs, "_digest")
    named = docs.withColumn(key, text_digest(quoted(text_column)))
    counted = materialise(count_rows(docs, id_column, text_column), "digests")
    known = index.table().select("digest")
    groups = materialise(
        group_digests(counted).join(known.hint("merge"), "digest", "left_anti"), "groups")
    index.append(groups)
    want = groups.select(
        F.col("digest").alias(key), F.col("keep_id").alias(unused(docs, "_keep")),
        F.col("n_keep").alias(unused(docs, "_copies")))
    keep, copies = want.columns[1:]
    same = (named[key] == want[key]) & quoted(id_column).cast("long").eqNullSafe(F.col(keep))
    won = named.join(want, same, "inner").drop(want[key])
    single = won.filter(F.col(copies) == 1)
    repeated = won.filter(F.col(copies) > 1).dropDuplicates([key])
    return single.unionByName(repeated).select(*[quoted(c) for c in docs.columns])


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index in a new folder of the shared folder."""
    return DigestIndex(spark, scratch_path(spark, "digest-index"))
