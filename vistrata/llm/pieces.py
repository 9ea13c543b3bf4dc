"""SentencePiece BPE encoding by backtracking, and decoding.

A text is right when every two neighbouring tokens are compatible: re-merging the
text of the pair must give the pair back. The encoder takes the longest token at a
position (matches of an Aho-Corasick automaton over the vocabulary), checks it
against the token before it, falls back to shorter tokens, steps back when none
fits, and remembers the positions that failed in a bitfield, so no position is
tried twice. Both checks and whole words are remembered, in bounded tables.

A merge crosses a place only if some token holds the two characters beside it, so a
text is cut, exactly, where none does: before runs of space marks, before punctuation
that follows other characters, around characters no longer token has. The vocabulary
is tested for these cuts when it is loaded. Tokens of equal
score (runs of space marks) have no strict order, which the pair check needs;
words that begin with several marks are merged directly. Characters outside the
vocabulary are one token each, written as the tokens of their UTF-8 bytes.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vistrata.llm.tables import quoted

MARK = "▁"
# Fixed values of the model format: the types of pieces.
NORMAL, BYTE = 1, 6
# Words, in each of two tables, and pairs remembered per task.
CACHE_WORDS = 300_000
CACHE_PAIRS = 500_000
NO_SCORE = float("-inf")


def load_vocabulary(path: str) -> dict:
    """Pieces and settings of a BPE model file, small enough to send to every task."""
    from sentencepiece import sentencepiece_model_pb2 as model_format

    model = model_format.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    shape = model.normalizer_spec
    plain = (model.trainer_spec.model_type == 2 and model.trainer_spec.byte_fallback
             and not shape.precompiled_charsmap and not shape.remove_extra_whitespaces
             and shape.escape_whitespaces
             and not model.trainer_spec.treat_whitespace_as_suffix
             and all(p.type != 4 for p in model.pieces))
    if not plain:
        raise ValueError("only BPE models with byte fallback and identity normalisation")
    return {
        "scores": {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == NORMAL},
        "bytes": {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE},
        "dummy_prefix": shape.add_dummy_prefix,
    }


class PieceCoder:
    """Encoder and decoder of one vocabulary, as held by a task."""

    def __init__(self, vocabulary: dict):
        self.scores = vocabulary["scores"]
        self.score = {p: s for p, (_, s) in self.scores.items()}
        self.byte_ids = vocabulary["bytes"]
        self.prefix = MARK if vocabulary["dummy_prefix"] else ""
        self.id_bytes = {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.id_text = {i: p.replace(MARK, " ") for p, (i, _) in self.scores.items()}
        self.split = re.compile(self._word_pattern()).findall
        self.pairs: dict = {}
        self.words: dict = {}
        self.older: dict = {}  # the table before, so frequent words are not coded again
        self._build()

    def _word_pattern(self) -> str:
        """A pattern whose matches, one after the other, are the parts no merge leaves."""
        beside = {(a, b) for p in self.scores for a, b in zip(p, p[1:])}
        if any(b == MARK and a != MARK for a, b in beside):
            return r"(?s).+"
        starters = {p for p in self.scores if len(p) == 1 and not p.isalnum() and p != MARK}
        while True:  # a starter follows only starters and marks within a token
            joined = {b for a, b in beside if b in starters and a not in starters and a != MARK}
            if not joined:
                break
            starters -= joined
        start = "".join(map(re.escape, sorted(starters)))
        starts = f"[{start}]" if start else "(?!)"
        # A line end is alone when no token of two characters or more has it.
        alone = "" if any("\n" in pair for pair in beside) else "\n"
        rest = f"[^{MARK}{start}{alone}]"
        parts = [f"{MARK}*{starts}*{rest}+", f"{MARK}*{starts}+", f"{MARK}+"]
        return "|".join(parts + ([alone] if alone else []))

    def _build(self) -> None:
        """The automaton holds the tokens that merging their own text can give."""
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[str, str | None] = {}
        reachable = [p for p in self.scores if len(p) == 1 or self.merge(p) == [p]]
        self.tokens = set(reachable)
        for piece in reachable:
            self.automaton.add_word(piece, (len(piece) - 1, piece))
        self.automaton.make_automaton()
        for piece in reachable:  # the next shorter token that begins it
            self.shorter[piece] = next(
                (piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.tokens),
                None)

    def merge(self, text: str) -> list[str]:
        """Merge neighbours by best score, leftmost first, until no pair is a token."""
        if len(text) <= 24:
            return self._merge_short(list(text))
        parts: list[str | None] = list(text)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list = []
        scores = self.scores

        def offer(i: int, j: int) -> None:
            known = scores.get(parts[i] + parts[j])
            if known:
                heapq.heappush(queue, (-known[1], i, j, len(parts[i]) + len(parts[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, size = heapq.heappop(queue)
            if parts[i] is None or parts[j] is None or after[i] != j \
                    or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p is not None]

    def _merge_short(self, parts: list[str]) -> list[str]:
        score = self.score.get
        gains = [score(a + b, NO_SCORE) for a, b in zip(parts, parts[1:])]
        while gains:
            best = max(gains)
            if best == NO_SCORE:
                break
            i = gains.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del gains[i]
            if i:
                gains[i - 1] = score(parts[i - 1] + parts[i], NO_SCORE)
            if i < len(gains):
                gains[i] = score(parts[i] + parts[i + 1], NO_SCORE)
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the text of both gives them back; remembered."""
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        known = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return known

    def longest_matches(self, text: str) -> list[str]:
        """The longest token at every position; an unknown character is its own token."""
        found = list(text)
        for end, (back, piece) in self.automaton.iter(text):
            found[end - back] = piece  # ends ascend, so the longest comes last
        return found

    def backtrack(self, text: str) -> list[str]:
        n = len(text)
        longest, pairs, shorter = self.longest_matches(text), self.pairs, self.shorter
        failed = bytearray(n // 8 + 1)  # a bit for each position no encoding can go on from
        tokens: list[str] = []
        at = 0
        token: str | None = longest[0]
        while True:
            if token is None:  # nothing fits here: give the last token up for a shorter one
                failed[at >> 3] |= 1 << (at & 7)
                if not tokens:
                    return self.merge(text)  # cannot happen with a consistent vocabulary
                token = tokens.pop()
                at -= len(token)
                token = shorter.get(token)
                continue
            end = at + len(token)
            fits = not failed[end >> 3] >> (end & 7) & 1
            if fits and tokens:
                fits = pairs.get((tokens[-1], token))
                if fits is None:
                    fits = self.compatible(tokens[-1], token)
            if fits:
                tokens.append(token)
                at = end
                if at == n:
                    return tokens
                token = longest[at]
            else:
                token = shorter.get(token)

    def pieces(self, word: str) -> list[str]:
        if word.startswith(MARK + MARK):
            return self.merge(word)
        return self.backtrack(word)

    def ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for piece in pieces:
            known = self.scores.get(piece)
            if known:
                out.append(known[0])
            else:
                out.extend(self.byte_ids[b] for b in piece.encode())
        return out

    def normal_words(self, text: str) -> list[str]:
        return self.split(self.prefix + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for word in self.normal_words(text) for i in self.ids(self.pieces(word))]

    def text_of(self, ids: list[int]) -> str:
        """Pieces with marks as spaces; runs of byte tokens as UTF-8."""
        try:
            return "".join([self.id_text[i] for i in ids])
        except KeyError:
            pass  # there are bytes
        out, pending = [], b""
        for i in ids:
            byte = self.id_bytes.get(i)
            if byte is not None:
                pending += byte
                continue
            if pending:
                out.append(_utf8(pending))
                pending = b""
            out.append(self.id_text.get(i, ""))
        return "".join(out) + (_utf8(pending) if pending else "")

    def decode(self, ids: list[int]) -> str:
        """The text of ids without the space that encoding puts in front."""
        text = self.text_of(ids)
        return text[1:] if self.prefix and text.startswith(" ") else text

    def coded_word(self, word: str) -> tuple[int, str, str]:
        """Of the mark and ``word``: number of ids, the ids as text, the text they decode to.

        Bytes stand for whole characters, so no run of bytes goes on in the next
        word in a way that decodes differently; words are decoded one by one.
        """
        known = self.older.get(word)
        if known is None:
            ids = [i for part in self.split(MARK + word) for i in self.ids(self.pieces(part))]
            known = (len(ids), ",".join(map(str, ids)), self.text_of(ids))
        if len(self.words) >= CACHE_WORDS:
            self.words, self.older = {}, self.words
        if len(word) <= 64:
            self.words[word] = known
        return known

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids, SHA-256 of the decoded text."""
        parts = text.split(" ")
        if not self.prefix or MARK in text or "" in parts:  # runs of marks, or no text
            ids = self.encode(text)
            return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256(self.decode(ids).encode()).hexdigest())
        known, code = self.words.get, self.coded_word
        coded = [known(w) or code(w) for w in parts]
        counts, ids, texts = zip(*coded) if coded else ((), (), ())
        decoded = "".join(texts)
        if self.prefix and decoded.startswith(" "):
            decoded = decoded[1:]
        return (sum(counts), hashlib.sha256(",".join(ids).encode()).hexdigest(),
                hashlib.sha256(decoded.encode()).hexdigest())


def _utf8(data: bytes) -> str:
    """UTF-8 with one replacement character for every byte that does not belong."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out = []
        while data:
            for n in range(min(4, len(data)), 0, -1):
                try:
                    out.append(data[:n].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                n = 1
            data = data[n:]
        return "".join(out)


def _mapped(docs: DataFrame, vocabulary: dict, columns: dict, schema: str, row) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one fixed vocabulary

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = PieceCoder(shared.value)
        gc.disable()  # the tables hold no cycles, and walking them takes a third of the time
        for batch in batches:
            out = [row(coder, x) for x in batch.itertuples(index=False, name=None)]
            yield pd.DataFrame(out, columns=names)

    names = [part.split()[0] for part in schema.split(", ")]
    return docs.select(*[quoted(c).alias(a) for a, c in columns.items()]).mapInPandas(run, schema)


def encode_documents(docs: DataFrame, vocabulary: dict, id_column: str = "doc_id",
                     text_column: str = "text") -> DataFrame:
    """``doc_id, ids`` of every row; NULL and empty texts have no ids."""
    def row(coder, x):
        return x[0], coder.encode(x[1] if isinstance(x[1], str) else "")

    keyed = docs.withColumn(id_column, quoted(id_column).cast("string"))
    out = _mapped(keyed, vocabulary, {"doc_id": id_column, "text": text_column},
                  "doc_id string, ids array<int>", row)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def decode_documents(coded: DataFrame, vocabulary: dict) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; NULL ids give an empty text."""
    def row(coder, x):
        return x[0], coder.decode([] if x[1] is None else [int(i) for i in x[1]])

    keyed = coded.withColumn("doc_id", F.col("doc_id").cast("string"))
    out = _mapped(keyed, vocabulary, {"doc_id": "doc_id", "ids": "ids"},
                  "doc_id string, text string", row)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def round_trips(docs: DataFrame, vocabulary: dict, id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row.

    Each text is encoded and decoded; NULL counts as empty and has no tokens.
    Repeated rows are coded each, other columns are not looked at, an empty table
    gives no rows. Only the current batch of texts is held.
    """
    def row(coder, x):
        return x[0], *coder.digest(x[1] if isinstance(x[1], str) else "")

    keyed = docs.select(quoted(id_column).cast("string").alias("doc_id"),
                        quoted(text_column).alias("text"))
    out = _mapped(keyed, vocabulary, {"doc_id": "doc_id", "text": "text"},
                  "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string", row)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
