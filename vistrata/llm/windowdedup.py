"""Removal of passages that an earlier document holds, by a count-min prefilter.

A window is a run of 13 words of one document. Every task counts the windows it sees
in a sketch; the merged sketch says for each window whether it may occur twice. A
second pass over the texts sends on only those windows, which are grouped exactly by a
96-bit digest: the sketch never counts too low, so no repeated window is lost, and one
that it wrongly lets through is alone in its group.

Windows that the sketch estimates to occur more often than a share of all windows are
counted first, by an aggregate that combines before the shuffle. Those that do occur so
often are few (their number times that count is at most the number of windows): their
least ids are broadcast and their occurrences are judged where they are read. What is
left to be gathered by digest are groups below that share. They travel packed, in shards
of bounded size by digest, and a task groups one shard at a time by sorting it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from vistrata.llm import sketch
from vistrata.llm.tables import quoted
from vistrata.llm.wordhash import WordHasher, mixed, numbers

WINDOW = 13
# A window is frequent if it occurs so often, or more than one in HOT_WINDOWS times; so no
# more than HOT_WINDOWS frequent ones, of 24 bytes each, are broadcast.
HOT, HOT_WINDOWS = 1_000, 500_000
# Texts that are hashed together; a longer text is hashed alone.
GROUP_BYTES = 2 << 20
# Bytes of text that stand for one window when the sketch is sized; only its rate of
# false alarms depends on this.
BYTES_PER_WINDOW = 6

ROW = ["doc_id", "no_id", "text_hash"]
# Windows that a shard is meant for; what it holds are those of them that may be repeated.
SHARD_WINDOWS = 2_000_000
PACKED = "shard long, judged boolean, digests binary, rows binary"
BUCKETS = "bucket long, rows binary"
PLACES = "doc_id long, no_id boolean, text_hash long, places binary"
_ROW = np.dtype([("doc_id", "<i8"), ("no_id", "?"), ("text_hash", "<i8"), ("place", "<i4")])
_DIGEST = np.dtype([("h1", "<i8"), ("h2", "<i4")])
FREQUENT = "h1 long, h2 int, least long, n long"
# Stands for no id at all among least ids: no id is smaller than NULL's.
_NO_ID = np.iinfo(np.int64).max
RESULT = "doc_id long, n_words long, n_removed long, text string"


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``doc_id, no_id, text_hash, text``: text as bytes, a hash that tells rows of one id apart.

    pandas has no whole numbers with gaps, so NULL ids are 0 with ``no_id``. Where every
    id has one text, the hash has nothing to tell and is 0 everywhere.
    """
    text, doc_id = F.coalesce(quoted(text_column), F.lit("")), quoted(id_column).cast("long")
    texts = docs.select(
        F.coalesce(doc_id, F.lit(0)).alias("doc_id"), doc_id.isNull().alias("no_id"),
        F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    ids = texts.groupBy("doc_id", "no_id").agg(
        F.min("text_hash").alias("a"), F.max("text_hash").alias("b"))
    if not ids.filter("a <> b").take(1):
        texts = texts.withColumn("text_hash", F.lit(0).cast("long"))
    return texts


def _packed(text: Column) -> Column:
    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        packer = zstandard.ZstdCompressor(level=1)
        return pd.Series([packer.compress(t) for t in texts], dtype=object)

    return pack(text)


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Bounds of neighbouring texts that are hashed together."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > GROUP_BYTES:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def window_digests(texts: list[bytes], hasher: WordHasher, size: int
                   ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of every window, text after text, and the number of windows of each text."""
    words, counts = hasher.of_texts(texts)
    n = np.maximum(counts - size + 1, 0)
    if not n.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), n
    runs = len(words) - size + 1
    sums = [np.zeros(runs, np.uint64), np.zeros(runs, np.uint64)]
    scrambled = [mixed(words ^ numbers(1, seed)[0]) for seed in (31, 32)]
    for which, factors in enumerate((numbers(size, 41), numbers(size, 42))):
        for j, factor in enumerate(factors | np.uint64(1)):
            sums[which] += scrambled[which][j:j + runs] * factor
    first = np.cumsum(counts) - counts
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return mixed(sums[0][at]), mixed(sums[1][at]), n


def _count_windows(texts: DataFrame, size: int, width: int, hot: int) -> sketch.Sketch:
    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        for _, _, (h1, _, _) in _hashed(batches, size):
            yield h1.view(np.uint64)

    return sketch.count_sketch(texts, keys, width, limit=2, high=hot)


def _hashed(batches: Iterator[pd.DataFrame], size: int):
    """Neighbouring texts at a time: their rows, the first and last, and their windows."""
    hasher = WordHasher()
    for batch in batches:
        held = list(batch["text"])
        for low, high in _groups(held):
            h1, h2, n = window_digests(held[low:high], hasher, size)
            yield batch, (low, high), (h1.view(np.int64), h2.astype(np.uint32).view(np.int32), n)


def _suspects(table: sketch.Sketch, h1: np.ndarray) -> np.ndarray:
    return np.flatnonzero(table.reaches(h1.view(np.uint64)))


def _frequent_windows(texts: DataFrame, size: int, merged, hot: int) -> pd.DataFrame:
    """``h1, h2, least`` of the windows that occur ``hot`` times, in order of ``h1``."""
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = merged.value
        for batch, (low, high), (h1, h2, n) in _hashed(batches, size):
            at = _suspects(table, h1)
            at = at[table.reaches_high(h1[at].view(np.uint64))]
            owner = np.repeat(np.arange(low, high), n)[at]
            ids = batch["doc_id"].to_numpy()[owner]
            least = np.where(batch["no_id"].to_numpy(bool)[owner], _NO_ID, ids)
            part = pd.DataFrame({"h1": h1[at], "h2": h2[at], "least": least, "n": 1})
            yield part.groupby(["h1", "h2"], as_index=False).agg({"least": "min", "n": "sum"})

    counted = texts.mapInPandas(find, FREQUENT).groupBy("h1", "h2").agg(
        F.min("least").alias("least"), F.sum("n").alias("n")).filter(F.col("n") >= hot)
    return counted.select("h1", "h2", "least").toPandas().sort_values("h1", ignore_index=True)


def _to_group(texts: DataFrame, size: int, merged, frequent, shards: int) -> DataFrame:
    """Windows that may be repeated by shard, and those that a smaller id is known to hold."""
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, known = merged.value, frequent.value
        k1, k2, least = (known[c].to_numpy() for c in ("h1", "h2", "least"))
        # Frequent windows with equal h1 are told apart by h2; their number is tiny.
        spare = np.flatnonzero(k1[1:] == k1[:-1]) + 1
        for batch, (low, high), (h1, h2, n) in _hashed(batches, size):
            at = _suspects(table, h1)
            if not len(at):
                continue
            owner = np.repeat(np.arange(low, high), n)[at]
            rows = np.zeros(len(at), _ROW)
            for name in ROW:
                rows[name] = batch[name].to_numpy()[owner]
            rows["place"] = (np.arange(len(h1)) - np.repeat(np.cumsum(n) - n, n))[at]
            digests = np.zeros(len(at), _DIGEST)
            digests["h1"], digests["h2"] = h1[at], h2[at]
            judged, later = np.zeros(len(at), bool), np.zeros(len(at), bool)
            if len(k1):
                first = np.minimum(np.searchsorted(k1, h1[at]), len(k1) - 1)
                for place in (first, *([s] for s in spare)):
                    same = (k1[place] == h1[at]) & (k2[place] == h2[at])
                    judged |= same
                    later |= same & (least[place] < _least_ids(rows))
            shard = mixed(digests["h1"].view(np.uint64)) % np.uint64(shards)
            yield from _packed_rows(shard[~judged], digests[~judged], rows[~judged])
            if later.any():
                yield pd.DataFrame({"shard": [int(shard[later][0])], "judged": [True],
                                    "digests": [b""], "rows": [_pack_array(rows[later])]})

    return texts.mapInPandas(find, PACKED)


def _least_ids(rows: np.ndarray) -> np.ndarray:
    return np.where(rows["no_id"], _NO_ID, rows["doc_id"])


def _pack_array(rows: np.ndarray) -> bytes:
    """Columns after each other, compressed: ids and places of neighbours are alike."""
    whole = b"".join(np.ascontiguousarray(rows[c]).tobytes() for c in _ROW.names)
    return zstandard.ZstdCompressor(level=1).compress(whole)


def _unpack_array(packed: bytes) -> np.ndarray:
    whole = zstandard.ZstdDecompressor().decompress(packed)
    out = np.zeros(len(whole) // _ROW.itemsize, _ROW)
    at = 0
    for c in _ROW.names:
        part = np.frombuffer(whole, _ROW[c], len(out), at)
        out[c] = part
        at += part.nbytes
    return out


def _packed_rows(shard: np.ndarray, digests: np.ndarray, rows: np.ndarray) -> Iterator[pd.DataFrame]:
    order = np.argsort(shard, kind="stable")
    shard, digests, rows = shard[order], digests[order], rows[order]
    first = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else []
    bounds = [*first, len(shard)]
    yield pd.DataFrame({
        "shard": shard[first].astype(np.int64) if len(shard) else np.zeros(0, np.int64),
        "judged": False,
        "digests": [digests[a:b].tobytes() for a, b in zip(bounds, bounds[1:])],
        "rows": [_pack_array(rows[a:b]) for a, b in zip(bounds, bounds[1:])]})


def _later(digests: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The rows whose digest a row with a smaller id has, too."""
    order = np.lexsort((digests["h2"], digests["h1"]))
    digests, rows = digests[order], rows[order]
    new = np.concatenate(([True], digests[1:] != digests[:-1]))
    ids = _least_ids(rows)
    least = np.minimum.reduceat(ids, np.flatnonzero(new))
    return rows[least[np.cumsum(new) - 1] < ids]


def _group(shards: int):
    """Shard by shard, the windows that a smaller id holds, too, in buckets of documents."""
    def dealt(rows: np.ndarray) -> Iterator[pd.DataFrame]:
        key = rows["doc_id"] * 2 + rows["no_id"]
        bucket = (mixed(key.view(np.uint64) ^ rows["text_hash"].view(np.uint64))
                  % np.uint64(shards)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, rows = bucket[order], rows[order]
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        bounds = [*first, len(rows)]
        yield pd.DataFrame({"bucket": bucket[first], "rows": [
            _pack_array(rows[a:b]) for a, b in zip(bounds, bounds[1:])]})

    def group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for batch in batches:
            for shard, judged, digests, rows in batch.itertuples(index=False):
                if shard != at and held:
                    found = _later(*map(np.concatenate, zip(*held)))
                    held = []
                    if len(found):
                        yield from dealt(found)
                at, rows = shard, _unpack_array(rows)
                if judged:
                    yield from dealt(rows)
                else:
                    held.append((np.frombuffer(digests, _DIGEST), rows))
        if held:
            found = _later(*map(np.concatenate, zip(*held)))
            if len(found):
                yield from dealt(found)

    return group


def _by_document(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bucket by bucket, one row per document with the places of its windows."""
    def documents(held: list[np.ndarray]) -> pd.DataFrame:
        rows = np.unique(np.concatenate(held))
        keys = rows[ROW]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        bounds, place = [*first, len(rows)], rows["place"]
        return pd.DataFrame({c: rows[c][first] for c in ROW} | {
            "places": [place[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]})

    at, held, size = None, [], 0
    for batch in batches:
        for bucket, rows in batch.itertuples(index=False):
            if bucket != at and held:
                yield documents(held)
                held, size = [], 0
            at, rows = bucket, _unpack_array(rows)
            held.append(rows)
            size += len(rows)
            if size > SHARD_WINDOWS:  # equal rows come once for each copy
                held = [np.unique(np.concatenate(held))]
                size = 0
    if held:
        yield documents(held)


def repeated_windows(texts: DataFrame, size: int = WINDOW) -> DataFrame:
    """``doc_id, no_id, text_hash, places``: windows that a document with a smaller id holds, too.

    One row per document that has any; ``places`` has their first words as packed 32-bit
    numbers.
    """
    spark = texts.sparkSession
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_windows = n_bytes // BYTES_PER_WINDOW
    hot = max(HOT, n_windows // HOT_WINDOWS)
    table = _count_windows(texts, size, sketch.width_for(n_windows), hot)
    merged = spark.sparkContext.broadcast(table)
    known = pd.DataFrame({"h1": [], "h2": [], "least": []}, dtype=np.int64)
    if table.high.any():
        known = _frequent_windows(texts, size, merged, hot)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_windows // SHARD_WINDOWS)
    sent = _to_group(texts, size, merged, spark.sparkContext.broadcast(known), shards)
    found = sent.repartition("shard").sortWithinPartitions("shard").mapInPandas(
        _group(shards), BUCKETS)
    return found.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(
        _by_document, PLACES)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   size: int = WINDOW) -> DataFrame:
    """The documents without the words of windows that an earlier document holds.

    ``doc_id, n_words, n_removed, text``: the kept words, joined by one space. Words are
    cut at ASCII white space and compared unchanged; earlier means a smaller id, whatever
    the order of the rows. A NULL text has no words. A NULL id is later than every other,
    and rows with equal or NULL ids do not count against each other; equal rows give a row
    each with the same result. A text shorter than a window keeps all words. No rows give
    no rows. Other columns of ``docs`` are not looked at. A task holds one text and its
    word hashes at a time, however long it is.
    """
    texts = _texts(docs, id_column, text_column)
    places = repeated_windows(texts, size)
    # Texts travel packed: they are most of what the join moves.
    marked = texts.withColumn("text", _packed(F.col("text"))).join(places.hint("merge"), ROW, "left")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words, removed, kept = [], [], []
            unpack = zstandard.ZstdDecompressor()
            for packed, found in zip(batch["text"], batch["places"]):
                parts = unpack.decompress(packed).split()
                gone = np.zeros(len(parts) + 1, np.int64)
                if found is not None:
                    first = np.frombuffer(found, "<i4")
                    np.add.at(gone, first, 1)
                    np.add.at(gone, first + size, -1)
                stays = np.flatnonzero(np.cumsum(gone)[:len(parts)] == 0)
                left = parts if len(stays) == len(parts) else [parts[i] for i in stays]
                words.append(len(parts))
                removed.append(len(parts) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "replace"))
            ids = pd.arrays.IntegerArray(
                batch["doc_id"].to_numpy(), batch["no_id"].to_numpy(bool))
            yield pd.DataFrame({"doc_id": ids, "n_words": words, "n_removed": removed,
                                "text": kept})

    return marked.select("doc_id", "no_id", "text", "places").mapInPandas(cut, RESULT)


def digests(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of ``remove_repeats``."""
    return remove_repeats(docs, **options).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
