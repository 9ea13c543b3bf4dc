"""Collocations: phrases of two to four words that occur together more than apart.

Counting goes order by order. Words are counted first; a longer run is counted only
where both runs it is made of by leaving out its last or its first word are frequent,
as it cannot be frequent otherwise. The frequent runs of an order reach the next scan
as a bit table of bounded size (``sketch``), which may let further runs through but
loses none; tasks add up their runs before the shuffle and the shuffle counts exactly,
by the words themselves. Of the runs of two words most are rare although their words are
not; a count-min sketch of them comes first and only those that it estimates frequent
are counted, again with none lost.

The frequent runs are then kept as two streams, one in prefix order (by their words
from the first on) and one in suffix order (from the last on). Sort-merge joins move
through the streams in lockstep with the cuts of the candidates: left parts against the
prefix order, right parts against the suffix order, and the longer phrases against the
shorter ones that they extend. No table of counts is held in memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from vistrata.llm import sketch
from vistrata.llm.tables import UPPER, quoted
from vistrata.llm.wordhash import WordHasher, mixed
from vistrata.plans.session import materialise

LONGEST = 4
LEAST = 30
SCALE = 2_000_000
# A phrase goes if a longer one that holds it has this share of its count.
SHARE = (80, 100)
TOP = 2_000
NO_LANG = "und"
# Bytes of text that a task looks at together; a longer word is looked at whole.
BLOCK_BYTES = 4 << 20

# The fixed marks that end a piece, and the white space between words.
_END, _SPACE = 10, 32
_FOLD = bytes.maketrans(
    (UPPER + "\t.,;:!?\x0b\x0c\r").encode(), (UPPER.lower() + " " + "\n" * 9).encode())
_GAPS = re.compile(b"  +")
_STEP = np.uint64(0x9E3779B97F4A7C15)

COUNTS = "lang string, size int, phrase string, n long"


def _lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class _Block:
    """The words of a block of folded text, and which of them were counted before."""

    def __init__(self, data: bytes, langs: list[str], starts: np.ndarray, carried: int,
                 hasher: WordHasher):
        self.data, self.langs, self.carried = data, langs, carried
        self.word, self.first, self.last = hasher.of_bytes(data)
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == _END)
        self.piece = np.searchsorted(ends, self.first)
        names, codes = np.unique(np.array(langs, dtype=object), return_inverse=True)
        self.names = [str(x) for x in names]
        self.lang = codes[np.searchsorted(starts, self.first, side="right") - 1]
        salt = np.array([_lang_hash(x) for x in self.names], np.uint64)
        self.key = mixed(self.word ^ salt[self.lang]) if len(self.word) else self.word

    def run_keys(self, size: int) -> np.ndarray:
        """A hash of the run of ``size`` words that starts at each word."""
        n = len(self.key) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = self.key[:n].copy()
        for j in range(1, size):
            out = mixed(out * _STEP + self.word[j:j + n])
        return out

    def runs(self, size: int) -> np.ndarray:
        """First words of the runs that lie within a piece and end after the carried words."""
        n = len(self.word) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        at = np.arange(max(0, self.carried - size + 1), n)
        return at[self.piece[at] == self.piece[at + size - 1]]


def _blocks(batches: Iterator[pd.DataFrame], hasher: WordHasher) -> Iterator[_Block]:
    """Blocks of many texts, or of parts of a long one with the last words of the part before."""
    held, langs, starts, size = [], [], [], 0

    def block(data: bytes, langs, starts, carried=0) -> _Block:
        return _Block(data, langs, np.array(starts), carried, hasher)

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            text = _GAPS.sub(b" ", text.translate(_FOLD))
            if held and size + len(text) > BLOCK_BYTES:
                yield block(b"\n".join(held), langs, starts)
                held, langs, starts, size = [], [], [], 0
            if len(text) <= BLOCK_BYTES:
                langs.append(lang)
                starts.append(size)
                held.append(text)
                size += len(text) + 1
                continue
            for data, carried in _parts(text):
                yield block(data, [lang], [0], carried)
    if held:
        yield block(b"\n".join(held), langs, starts)


def _parts(text: bytes) -> Iterator[tuple[bytes, int]]:
    """Parts of a long text, cut at white space, after up to ``LONGEST - 1`` words of before."""
    at, before, carried = 0, b"", 0
    while at < len(text):
        places = [p for p in (text.find(s, at + BLOCK_BYTES) for s in (b" ", b"\n")) if p >= 0]
        upto = min(places) + 1 if places else len(text)
        data = before + text[at:upto]
        yield data, carried
        begin, carried = _last_words(data, LONGEST - 1)
        before = data[begin:]
        at = upto


def _last_words(data: bytes, n: int) -> tuple[int, int]:
    """Where the last ``n`` words of ``data`` begin, and how many there are."""
    begin = at = len(data)
    for found in range(n):
        while at and data[at - 1] in (_SPACE, _END):
            at -= 1
        if not at:
            return begin, found
        begin = at = max(data.rfind(b" ", 0, at), data.rfind(b"\n", 0, at)) + 1
    return begin, n


def _possible(block: _Block, size: int, shorter) -> np.ndarray:
    """First words of the runs whose two shorter runs are frequent."""
    at = block.runs(size)
    if shorter is not None and len(at):
        keys = block.run_keys(size - 1)
        at = at[shorter.value.reaches(keys[at])]
        at = at[shorter.value.reaches(keys[at + 1])]
    return at


def _estimate_runs(texts: DataFrame, size: int, shorter, least: int, n_words: int):
    """A sketch that says which runs may occur ``least`` times, broadcast."""
    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        hasher = WordHasher()
        for block in _blocks(batches, hasher):
            yield block.run_keys(size)[_possible(block, size, shorter)]

    table = sketch.count_sketch(texts, keys, sketch.width_for(n_words), limit=least)
    return texts.sparkSession.sparkContext.broadcast(table)


def _count_runs(texts: DataFrame, size: int, shorter, likely=None) -> DataFrame:
    """``lang, size, phrase, n``, one row per run and block; sizes 0 count all words."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for block in _blocks(batches, hasher):
            at = _possible(block, size, shorter)
            if likely is not None and len(at):
                at = at[likely.value.reaches(block.run_keys(size)[at])]
            if not len(at):
                continue
            keys, others = block.run_keys(size)[at], _second_keys(block, at, size)
            order = np.lexsort((others, keys))
            keys, others = keys[order], others[order]
            new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (others[1:] != others[:-1])))
            place = np.flatnonzero(new)
            n = np.diff(np.append(place, len(keys)))
            one = at[order[place]]
            data, names = block.data, block.names
            phrases = [data[a:b].decode("utf-8", "replace") for a, b in zip(
                block.first[one].tolist(), block.last[one + size - 1].tolist())]
            yield pd.DataFrame({
                "lang": np.array(names, dtype=object)[block.lang[one]], "size": np.int32(size),
                "phrase": phrases, "n": n})
            if size == 1:
                total = np.bincount(block.lang[at], minlength=len(names))
                yield pd.DataFrame({"lang": names, "size": np.int32(0), "phrase": "",
                                    "n": total.astype(np.int64)})

    return texts.mapInPandas(count, COUNTS)


def _second_keys(block: _Block, at: np.ndarray, size: int) -> np.ndarray:
    """A second, independent hash of runs, so that runs are told apart by 128 bits."""
    out = block.lang[at].astype(np.uint64)
    for j in range(size):
        out = mixed(out + mixed(block.word[at + j] ^ _STEP))
    return out


def _frequent_table(runs: DataFrame, size: int):
    """The bit table of frequent runs, broadcast; its size is bounded by ``sketch.MAX_WIDTH``."""
    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        hasher = WordHasher()
        for batch in batches:
            phrases = [p.encode("utf-8", "surrogatepass") for p in batch["phrase"]]
            starts = np.cumsum([0] + [len(p) + 1 for p in phrases[:-1]])
            block = _Block(b"\n".join(phrases), list(batch["lang"]), starts, 0, hasher)
            yield block.run_keys(size)[block.runs(size)]

    width = sketch.width_for(runs.count(), 32.0)
    table = sketch.count_sketch(runs.select("lang", "phrase"), keys, width, limit=1)
    return runs.sparkSession.sparkContext.broadcast(table)


def frequent_runs(docs: DataFrame, lang_column: str = "lang", text_column: str = "text",
                  least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """``lang, size, phrase, n``: runs of up to ``longest`` words that occur ``least`` times.

    All occurrences within pieces count, overlapping ones too. ``size`` 0 has the number
    of all words of a language. Texts are lower-cased (A-Z) and cut into pieces at marks
    and line ends, pieces into words at spaces and tabs. A NULL language is ``und``, a
    NULL text is empty. No rows give no rows.
    """
    texts = docs.select(
        F.coalesce(quoted(lang_column), F.lit(NO_LANG)).alias("lang"),
        F.coalesce(quoted(text_column), F.lit("")).cast("binary").alias("text"))
    shorter, levels = None, []
    for size in range(1, longest + 1):
        likely = None
        if size == 2:
            n_words = sketch.count_rows(levels[0].filter("size = 0"), "n")
            likely = _estimate_runs(texts, size, shorter, least, n_words)
        counted = _count_runs(texts, size, shorter, likely).groupBy("lang", "size", "phrase").agg(
            F.sum("n").alias("n"))
        found = materialise(
            counted.filter((F.col("n") >= least) | (F.col("size") == 0)), f"runs-{size}")
        levels.append(found)
        if size < longest:
            shorter = _frequent_table(found.filter(F.col("size") == size), size)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def _reversed_words(phrase):
    return F.array_join(F.reverse(F.split(phrase, " ")), " ")


def scored(runs: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, score, longer``: candidates with their weakest cut.

    The joins are told to sort and merge: by ``phrase``, the prefix order, and by its words
    from the last to the first, the suffix order.
    ``longer`` is the largest count of a phrase one word longer that holds the candidate;
    what holds it in a still longer one is no more frequent than that.
    """
    words = runs.filter("size >= 1").select("lang", "size", "phrase", "n")
    prefix = materialise(words, "prefix-order")
    suffix = prefix.select("lang", _reversed_words(F.col("phrase")).alias("mirror"), "n")
    candidates = prefix.filter("size >= 2")
    cuts = candidates.select(
        "lang", "phrase", F.col("n").alias("a"),
        F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("first_part", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("rest", _reversed_words(F.expr("substr(phrase, length(first_part) + 2)")))
    lefts = prefix.select("lang", F.col("phrase").alias("first_part"), F.col("n").alias("l"))
    rights = suffix.select("lang", F.col("mirror").alias("rest"), F.col("n").alias("r"))
    both = cuts.join(lefts.hint("merge"), ["lang", "first_part"]).join(
        rights.hint("merge"), ["lang", "rest"])
    score = F.expr(
        f"(cast(a as decimal(20,0)) * cast({SCALE} as decimal(7,0)))"
        " div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    weakest = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.explode(F.array(
        F.expr("substring_index(phrase, ' ', size - 1)"),
        F.expr("substring_index(phrase, ' ', 1 - size)")))
    extensions = candidates.filter("size >= 3").select("lang", inner.alias("phrase"), "n").groupBy(
        "lang", "phrase").agg(F.max("n").alias("longer"))
    return weakest.join(extensions.hint("merge"), ["lang", "phrase"], "left").select(
        "lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
        F.col("cut.score").alias("score"), "longer")


def collocations(docs: DataFrame, lang_column: str = "lang", text_column: str = "text",
                 least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of each language.

    ``a`` counts the phrase, ``l`` and ``r`` the parts at its weakest cut (ties: the
    first), ``n`` all words of the language; the score is ``SCALE * a / (l + r)``, rounded
    down. A phrase goes if one longer phrase that holds it has ``SHARE`` of its count. Order:
    score, then ``a``, descending, then the phrase by its bytes. See ``frequent_runs`` for
    NULLs and empty texts; repeated rows count each. The best are found per part of a
    language first, so no task sorts a whole language.
    """
    runs = frequent_runs(docs, lang_column, text_column, least, longest)
    part, whole = SHARE
    kept = scored(runs).filter(
        F.col("longer").isNull() | (
            F.col("longer").cast("decimal(20,0)") * whole < F.col("a").cast("decimal(20,0)") * part))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    dealt = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    best = dealt.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    totals = runs.filter("size = 0").select("lang", "n")
    return ranked.join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
