"""Removal of every byte covered by a 200-byte string that occurs elsewhere, too.

Suffix arrays compare what could be equal; anchors bring it together. The anchor of a
window of ``WINDOW`` bytes is its run of ``GRAM`` bytes with the least hash, the first of
equals, so equal windows have equal anchors at the same place, and all windows of an
anchor lie in the anchor's context, ``WINDOW - GRAM`` bytes before it and ``WINDOW`` from
it on. Three cases, by anchor and context digests over the whole corpus:

* the anchor's bytes occur once: none of its windows is repeated;
* the whole context occurs twice: all its windows are;
* else the contexts of equal anchors differ at an edge of what they share. One occurrence
  of each distinct context goes to the task of its anchor, which builds the suffix array
  of the contexts by linear grouping (``lyndon``) and marks the windows that equal their
  neighbour in the array and stand at another place. Before sorting, contexts are cut
  to what any other of their anchor may share, and those that lie in another are left
  to it as a further place of that part.

An anchor with more distinct contexts than ``GROUP_CONTEXTS`` is not gathered in a task:
its windows are counted by digest in the shuffle instead, with the same result. Documents
are told apart by their digest, so copies are one text with a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vistrata.llm.lyndon import suffix_array
from vistrata.llm.tables import join_groups, quoted
from vistrata.llm.wordhash import as_bytes, mixed, numbers
from vistrata.plans.session import materialise

WINDOW = 200
GRAM = 48
LEFT = WINDOW - GRAM
# Windows of a long text that are looked at together, and bytes sorted together.
SEGMENT = 1 << 20
SORT_BYTES = 1 << 19
GROUP_CONTEXTS = 20_000
# Contexts of an anchor in which others are looked for; those found in none are sorted, too.
OPEN_CONTEXTS = 8
_PLACE_BITS = np.uint64(28)


class RollingHash:
    """Hashes of any part of a segment, from sums of weighted bytes."""

    def __init__(self, seed: int):
        self.byte = numbers(256, seed)
        self.factor = int(numbers(1, seed + 1)[0]) | 1
        self.inverse = pow(self.factor, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        size = max(n, 2 * len(self.up))
        self.up, self.down = (
            np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, f, np.uint64))))
            for f in (self.factor, self.inverse))

    def load(self, raw: np.ndarray) -> None:
        if len(raw) >= len(self.up):
            self._grow(len(raw))
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.byte[raw] * self.up[:len(raw)], out=self.sums[1:])

    def part(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (self.sums[high] - self.sums[low]) * self.down[low]


def _sliding_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of ``width`` keys, from block-wise running minima."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


class Anchors:
    """The anchors of a text: their gram and context hashes and their places."""

    def __init__(self):
        self.grams, self.contexts = RollingHash(21), RollingHash(31)

    def _of_segment(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.grams.load(raw)
        at = np.arange(len(raw) - GRAM + 1)
        hashes = mixed(self.grams.part(at, at + GRAM))
        keys = (hashes >> _PLACE_BITS << _PLACE_BITS) | at.astype(np.uint64)
        least = _sliding_minimum(keys, LEFT + 1) & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))
        places = least[np.concatenate(([True], least[1:] != least[:-1]))].astype(np.int64)
        return places, hashes[places]

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(text)
        grams, contexts, places = [], [], []
        last = -1
        for first in range(0, max(0, n - WINDOW + 1), SEGMENT):
            # The windows that start in the segment, and the contexts of their anchors.
            low = max(0, first - LEFT)
            stop = min(n, first + SEGMENT + WINDOW - 1)
            raw = np.frombuffer(text, np.uint8, stop - first, first)
            at, hashes = self._of_segment(raw)
            fresh = at + first > last
            at, hashes = at[fresh] + first, hashes[fresh]
            if not len(at):
                continue
            last = int(at[-1])
            high = min(n, stop + WINDOW)
            self.contexts.load(np.frombuffer(text, np.uint8, high - low, low))
            begin, end = np.maximum(at - LEFT, 0), np.minimum(at + WINDOW, n)
            own = self.contexts.part(begin - low, end - low)
            shape = ((at - begin) * 1024 + (end - at)).astype(np.uint64)
            grams.append(hashes)
            contexts.append(mixed(own + shape * np.uint64(0x9E3779B97F4A7C15)))
            places.append(at)
        if not places:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x).view(np.int64) for x in (grams, contexts, places))


def parsed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``doc_id, text_key, n_bytes, sha256`` and the anchors of every row, in arrays."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors = Anchors()
        for batch in batches:
            data = as_bytes(batch["text"])
            found = [anchors.of(text) for text in data]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"],
                "text_key": [_key(text) for text in data],
                "n_bytes": [len(text) for text in data],
                "sha256": [hashlib.sha256(text).hexdigest() for text in data],
                "gram": [x[0] for x in found], "context": [x[1] for x in found],
                "place": [x[2] for x in found]})

    rows = docs.select(quoted(id_column).cast("string").alias("doc_id"),
                       quoted(text_column).alias("text"))
    out = rows.mapInPandas(
        run, "doc_id string, text_key binary, n_bytes long, sha256 string,"
             " gram array<long>, context array<long>, place array<long>")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _key(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _shared_lengths(parts: list[bytes], group: np.ndarray, width: int) -> np.ndarray:
    """Per part, the longest beginning it shares with another part of its group."""
    n = len(parts)
    wide = np.zeros(n, f"S{width + 8}")
    names = group.astype(">u8").view("S8").tolist()
    wide[:] = [g.ljust(8, b"\0") + p for g, p in zip(names, parts)]
    order = np.argsort(wide, kind="stable")
    cells = wide[order].view(np.uint8).reshape(n, -1)
    sizes = np.array([len(p) for p in parts])[order]
    differ = cells[1:] != cells[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width + 8) - 8
    common = np.minimum(common, np.minimum(sizes[1:], sizes[:-1]))
    common[group[order][1:] != group[order][:-1]] = 0
    best = np.zeros(n, np.int64)
    best[order[1:]] = common
    best[order[:-1]] = np.maximum(best[order[:-1]], common)
    return best


def trimmed(contexts: list[bytes], lefts: list[int], counts: list[int], group: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the part of each context that another of its group may share.

    A window that two contexts share consists of bytes before the anchor that both
    share and of bytes from the anchor on that both share, so nothing beyond the
    longest shared length on either side can matter.
    """
    left, sizes = np.array(lefts), np.array([len(c) for c in contexts])
    ahead = _shared_lengths([c[n:] for c, n in zip(contexts, lefts)], group, WINDOW)
    back = _shared_lengths([c[:n][::-1] for c, n in zip(contexts, lefts)], group, LEFT)
    many = np.array(counts) > 1
    return np.where(many, 0, left - back), np.where(many, sizes, left + ahead)


def repeated_starts(contexts: list[bytes], places: list[tuple[int, int]],
                    parts: list[list[tuple[int, int]]]) -> list[np.ndarray]:
    """Per context, the offsets of its windows that also start at another place.

    ``places`` has where each context stands: a text and its first byte. ``parts``
    has the bounds of the parts of it that stand at further places.
    """
    sizes = np.array([len(c) for c in contexts])
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    raw = np.zeros(int(sizes.sum()) + len(sizes), np.uint16)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    offset = np.arange(len(raw)) - np.repeat(starts, sizes + 1)
    raw[offset < sizes[owner]] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.uint16) + 1
    order = np.array(suffix_array(raw.tolist()), np.int64)
    order = order[offset[order] + WINDOW <= sizes[owner[order]]]
    same = np.zeros(len(order), bool)  # as the one before, over a whole window
    step, span = 4_096, np.arange(WINDOW)
    for low in range(1, len(order), step):
        here = order[low:low + step]
        there = order[low - 1:low - 1 + len(here)]
        near = (raw[here] == raw[there]) & (raw[here + WINDOW - 1] == raw[there + WINDOW - 1])
        at = np.flatnonzero(near)
        same[low + at] = (raw[here[at][:, None] + span] == raw[there[at][:, None] + span]).all(1)
    # A run of equal windows is repeated when they do not all stand at one place.
    text = np.array([p[0] for p in places], np.int64)
    first = np.array([p[1] for p in places], np.int64)
    more = np.zeros(len(raw) + 1, np.int64)  # further places of the window at each symbol
    for start, bounds in zip(starts, parts):
        for low, high in bounds:
            more[start + low] += 1
            more[start + high - WINDOW + 1] -= 1
    several = np.cumsum(more) > 0
    where = (text[owner[order]] << 40) + first[owner[order]] + offset[order]
    run = np.cumsum(~same) - 1
    n_runs = int(run[-1]) + 1 if len(run) else 0
    low, high = np.full(n_runs, np.iinfo(np.int64).max), np.full(n_runs, -1)
    np.minimum.at(low, run, where)
    np.maximum.at(high, run, where)
    many = low < high
    many[run[several[order]]] = True
    hit = order[many[run]] if n_runs else order
    return _by_owner(owner[hit], offset[hit], len(sizes))


def _by_owner(owner: np.ndarray, offset: np.ndarray, n: int) -> list[np.ndarray]:
    order = np.lexsort((offset, owner))
    return np.split(offset[order], np.cumsum(np.bincount(owner, minlength=n))[:-1])


def _spans(starts: np.ndarray) -> list[tuple[int, int]]:
    """Merged bytes of windows at ascending starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > WINDOW) + 1
    return [(int(p[0]), int(p[-1]) + WINDOW) for p in np.split(starts, cut)]


def _all_known(size: int, parts: list[tuple[int, int]]) -> bool:
    """Whether each window of a context of ``size`` bytes lies in one of its parts."""
    starts = 0  # windows from here on are still to be found in a part
    for low, high in sorted(parts):
        if low > starts:
            break
        starts = max(starts, high - WINDOW + 1)
    return starts > size - WINDOW


def _starts_of_groups(group: np.ndarray, texts: list[bytes], places: list[tuple[int, int]],
                      parts: list[list[tuple[int, int]]]) -> list[np.ndarray]:
    """``repeated_starts`` of the contexts, where those of a group could share more.

    Equal windows of an anchor stand at one distance from it. A group whose contexts all
    consist of parts known from further places has no other windows to find, so
    its bytes are not sorted.
    """
    known = np.array([_all_known(len(t), p) for t, p in zip(texts, parts)])
    open_ = np.isin(group, group[~known])
    hits = [np.arange(len(t) - WINDOW + 1) for t in texts]
    at = np.flatnonzero(open_).tolist()
    if at:
        for i, hit in zip(at, repeated_starts(*([x[i] for i in at] for x in (texts, places, parts)))):
            hits[i] = hit
    return hits


def _sorted_spans(rows: list[tuple]) -> pd.DataFrame:
    """Repeated spans of whole groups of contexts: rows of gram, key, first, left, n, bytes."""
    grams, keys, firsts, lefts, counts, contexts = zip(*rows)
    group = np.unique(np.array(grams, np.int64), return_inverse=True)[1]
    low, high = trimmed(contexts, lefts, counts, group)
    code = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    whole: list[tuple[int, list[tuple[int, int, int]]]] = []  # a context and what it contains
    at_group = np.flatnonzero(high - low >= WINDOW)
    at_group = at_group[np.lexsort((low[at_group] - high[at_group], group[at_group]))]
    open_, current = [], -1
    for i in at_group.tolist():
        if group[i] != current:
            current, open_ = group[i], []
        own, here = contexts[i][low[i]:high[i]], int(low[i]) - lefts[i]
        for held, inside in open_:
            shift = here - (int(low[held]) - lefts[held])
            if 0 <= shift and contexts[held][low[held] + shift:high[held]].startswith(own):
                inside.append((i, shift, shift + len(own)))
                break
        else:
            whole.append((i, []))
            if len(open_) < OPEN_CONTEXTS:
                open_.append(whole[-1])
    out: list[tuple] = []
    if whole:
        texts = [contexts[i][low[i]:high[i]] for i, _ in whole]
        places = [(code[keys[i]], firsts[i] + int(low[i])) for i, _ in whole]
        parts = [[(a, b) for _, a, b in inside]
                 + ([(0, len(t))] if counts[i] > 1 else [])
                 for (i, inside), t in zip(whole, texts)]
        found = _starts_of_groups(group[[i for i, _ in whole]], texts, places, parts)
        for (held, inside), text, hit in zip(whole, texts, found):
            for i, shift, end in [(held, 0, len(text)), *inside]:
                at = firsts[i] + int(low[i]) - shift
                own = hit[(hit >= shift) & (hit <= end - WINDOW)]
                out += [(keys[i], at + a, at + b) for a, b in _spans(own)]
    return pd.DataFrame(out, columns=["text_key", "low", "high"])


def _sort_contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come in the order of their gram; whole groups are sorted together."""
    held: list[tuple] = []
    size, gram = 0, None
    for batch in batches:
        for g, key, first, left, n, context in zip(
                batch["gram"], batch["text_key"], batch["first"], batch["left"], batch["n"],
                batch["bytes"]):
            if g != gram and size >= SORT_BYTES:
                yield _sorted_spans(held)
                held, size = [], 0
            gram = g
            held.append((int(g), bytes(key), int(first), int(left), min(int(n), 2),
                         bytes(context)))
            size += len(context)
    if held:
        yield _sorted_spans(held)


def _cut_contexts(texts: DataFrame, edges: DataFrame) -> DataFrame:
    """The bytes of the contexts that edge rows name; texts meet them once."""
    lists = edges.groupBy("text_key").agg(
        F.collect_list(F.struct("gram", "place", "n", "crowded")).alias("edges"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text, named in zip(batch["text_key"], batch["text"], batch["edges"]):
                data = as_bytes([text])[0]
                for e in named:
                    first = max(0, e["place"] - LEFT)
                    out.append((e["gram"], key, first, e["place"] - first, e["n"], e["crowded"],
                                data[first:e["place"] + WINDOW]))
            yield pd.DataFrame(out, columns=[
                "gram", "text_key", "first", "left", "n", "crowded", "bytes"])

    return texts.join(lists, "text_key").mapInPandas(
        run, "gram long, text_key binary, first long, left long, n long, crowded boolean,"
             " bytes binary")


def _window_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for key, first, n, data in zip(
                batch["text_key"], batch["first"], batch["n"], batch["bytes"]):
            out += [(_key(data[i:i + WINDOW]), key, first + i, n)
                    for i in range(len(data) - WINDOW + 1)]
        yield pd.DataFrame(out, columns=["window", "text_key", "low", "n"])


def _count_windows(contexts: DataFrame) -> DataFrame:
    """Repeated windows of crowded anchors, by digest."""
    rows = contexts.mapInPandas(
        _window_digests, "window binary, text_key binary, low long, n long")
    rows = materialise(rows.groupBy("window", "text_key", "low").agg(F.max("n").alias("n")),
                       "windows")
    found = rows.groupBy("window").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_rows")).filter("total > 1")
    met = join_groups(rows.drop("n"), found, "window", F.col("n_rows"), max(1, rows.count()))
    return met.select("text_key", "low", (F.col("low") + WINDOW).alias("high"))


def repeated_spans(anchors: DataFrame, texts_of, group_contexts: int = GROUP_CONTEXTS
                   ) -> tuple[DataFrame, DataFrame]:
    """``text_key, low, high``, which may overlap, and the texts that have any anchor twice.

    ``anchors`` has ``text_key, gram, context, place`` for every row of the corpus;
    ``texts_of(keys)`` returns ``text_key, text`` of the named texts.
    """
    often = anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n_gram")).filter("n_gram > 1")
    met = anchors.join(often.select("gram"), "gram")
    cand = materialise(met.groupBy("text_key", "place", "gram", "context").agg(
        F.count(F.lit(1)).alias("m")), "candidates")
    contexts = materialise(cand.groupBy("gram", "context").agg(
        F.sum("m").alias("n"), F.count(F.lit(1)).alias("n_rows"),
        F.min(F.struct("text_key", "place")).alias("rep")), "contexts")
    twice = contexts.filter("n > 1").select(
        F.struct("gram", "context").alias("both"), "n_rows")
    rows = cand.select(F.struct("gram", "context").alias("both"), "text_key", "place")
    full = join_groups(rows, twice, "both", F.col("n_rows"), max(1, cand.count())).select(
        "text_key", F.greatest(F.col("place") - LEFT, F.lit(0).cast("long")).alias("low"),
        (F.col("place") + WINDOW).alias("high"))
    full = materialise(full.distinct(), "full-spans")
    several = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("d")).filter("d > 1")
    edges = materialise(contexts.join(several, "gram").select(
        "gram", F.col("rep.text_key").alias("text_key"), F.col("rep.place").alias("place"), "n",
        (F.col("d") > group_contexts).alias("crowded")), "edges")
    keys = full.select("text_key").unionByName(edges.select("text_key")).distinct()
    texts = materialise(texts_of(keys), "texts")
    cut = materialise(_cut_contexts(texts, edges), "edge-contexts")
    by_gram = cut.filter(~F.col("crowded")).drop("crowded").repartition("gram")
    sorted_spans = by_gram.sortWithinPartitions("gram").mapInPandas(
        _sort_contexts, "text_key binary, low long, high long")
    crowded = cut.filter("crowded")
    parts = [full, materialise(sorted_spans, "edge-spans")]
    if crowded.take(1):
        parts.append(_count_windows(crowded))
    spans = parts[0]
    for part in parts[1:]:
        spans = spans.unionByName(part)
    return spans, texts


def _cut_texts(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """``text_key, n_removed, n_spans, kept_sha256, kept`` of the texts with spans."""
    lists = spans.groupBy("text_key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text, named in zip(batch["text_key"], batch["text"], batch["spans"]):
                data = as_bytes([text])[0]
                merged: list[list[int]] = []
                for low, high in sorted((s["low"], min(s["high"], len(data))) for s in named):
                    if high - low < WINDOW:
                        continue  # a context cut short by the text's ends holds no window
                    if merged and low <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], high)
                    else:
                        merged.append([low, high])
                bounds = [0, *(x for span in merged for x in span), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2]))
                out.append((key, len(data) - len(kept), len(merged),
                            hashlib.sha256(kept).hexdigest(), kept))
            yield pd.DataFrame(
                out, columns=["text_key", "n_removed", "n_spans", "kept_sha256", "kept"])

    return texts.join(lists, "text_key").mapInPandas(
        run, "text_key binary, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   group_contexts: int = GROUP_CONTEXTS, with_bytes: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs``.

    Removed is each byte covered by a 200-byte string that also starts anywhere
    else in the texts, the same text included; texts are not joined. NULL texts
    are empty; texts under 200 bytes lose nothing; rows with equal texts lose
    everything. ``with_bytes`` adds the remaining bytes as ``kept``, NULL where
    the text is whole. Other columns are not looked at.
    """
    table = materialise(parsed(docs, id_column, text_column), "parsed")
    rows = table.select("doc_id", "text_key", "n_bytes", "sha256")
    texts_by_key = materialise(rows.groupBy("text_key").agg(
        F.count(F.lit(1)).alias("m"), F.min("doc_id").alias("id")), "text-keys")
    anchors = table.select("text_key", F.explode(F.arrays_zip("gram", "context", "place"))
                           .alias("x")).select("text_key", "x.gram", "x.context", "x.place")

    @F.pandas_udf("binary")
    def key_of(texts: pd.Series) -> pd.Series:
        return pd.Series([_key(t) for t in as_bytes(texts)], dtype=object)

    def texts_of(keys: DataFrame) -> DataFrame:
        wanted = keys.join(texts_by_key, "text_key").select("text_key", F.col("id").alias("doc"))
        source = docs.select(quoted(id_column).cast("long").alias("own"),
                             quoted(text_column).alias("text"))
        met = source.join(wanted, F.col("own").eqNullSafe(F.col("doc")))
        # An id may come with other texts, and with the same text again.
        met = met.withColumn("key", key_of("text")).filter("key = text_key")
        met = met.select("text_key", "text")
        repeat = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").take(1)
        return met.dropDuplicates(["text_key"]) if repeat else met

    spans, texts = repeated_spans(anchors, texts_of, group_contexts)
    cut = _cut_texts(texts, spans)
    if not with_bytes:
        cut = cut.drop("kept")
    cut = materialise(cut, "cut-texts")
    names = [c for c in cut.columns if c != "text_key"]
    per_text = texts_by_key.join(cut, "text_key", "left").select("text_key", "m", *names)
    met = join_groups(rows, materialise(per_text, "per-text"), "text_key", F.col("m"),
                      max(1, rows.count()))
    out = met.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
        *(["kept"] if with_bytes else []))
    return out
