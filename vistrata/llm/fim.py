"""Fill-in-the-middle texts by secondary sort.

Every text is cut into lines, the lines into a prefix, a middle and a suffix, and
each section leaves its task as pieces of bounded size that carry the place they
have in the output. One shuffle brings the pieces of a document together, sorted
by that place, so a task streams outputs of any length through a digest without
holding a whole text. Restoration works on that stream alone: it finds the
markers, gives the pieces their old order, sorts again inside the partition (no
second shuffle) and streams them through a second digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vistrata.llm.tables import quoted

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
# The order of the sections in an output by its form, and of the sections in a text.
FORMS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
RESTORED = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
SEED, RATE, SPM_RATE = 7, 100, 50
PIECE_BYTES = 1 << 16

# Ids travel as text: pandas has no whole numbers with gaps.
KEY = ["doc_key", "text_md5"]
PIECES = ("doc_key string, text_md5 binary, seq long, copies long, form string, n long,"
          " prefix_chars long, middle_chars long, piece binary")
OLD_PLACES = ("doc_key string, text_md5 binary, section int, seq long, copies long, form string,"
              " n long, prefix_chars long, middle_chars long, output_sha256 string, piece binary")
RESULT = ("doc_key string, n long, form string, prefix_chars long, middle_chars long,"
          " output_sha256 string, restored_sha256 string")
TEXTS = "doc_key string, n long, form string, text string"


def pieces(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
           rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED,
           piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The outputs as pieces, those of a document together and in order of ``seq``.

    The cuts, and whether and how a text is rearranged, depend on the digest of
    seed and id alone. ``piece`` is UTF-8; the pieces of a document (``doc_key``
    and ``text_md5``) in order are its output. A NULL text counts as empty, a
    NULL id as the empty word. An empty text and one that holds a marker stay
    plain. Rows equal in id and text give their pieces once, or once for each
    batch that holds them, with equal ``seq``; ``copies`` at ``seq`` 0 counts
    them. Other columns of ``docs`` are not looked at; no rows give no pieces.
    """
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[tuple, int] = {}
            kept = []
            for doc_key, text in zip(batch["doc_key"], batch["text"]):
                key = (doc_key, hashlib.md5(text).digest())
                if key not in seen:
                    kept.append((key, text))
                seen[key] = seen.get(key, 0) + 1
            rows, size = [], 0
            for key, text in kept:
                for row in _cut_text(key, text, seen[key], rate, spm_rate, seed, piece_bytes):
                    rows.append(row)
                    size += len(row[-1])
                    if size >= 64 * piece_bytes:
                        yield _frame(rows, PIECES)
                        rows, size = [], 0
            if rows:
                yield _frame(rows, PIECES)

    texts = docs.select(
        quoted(id_column).cast("long").cast("string").alias("doc_key"),
        F.coalesce(quoted(text_column), F.lit("")).cast("binary").alias("text"))
    return texts.mapInPandas(cut, PIECES).repartition(*KEY).sortWithinPartitions(*KEY, "seq")


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [part.split()[0] for part in schema.split(",")]
    frame = pd.DataFrame(rows, columns=names, dtype=object)
    for name, part in zip(names, schema.split(",")):
        if part.split()[1] in ("long", "int"):
            frame[name] = frame[name].astype("Int64")
    return frame


def _line_ends(text: bytes) -> np.ndarray:
    """Where the first 0, 1, ... lines of a text end."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    rest = [len(text)] if text and not text.endswith(b"\n") else []
    return np.concatenate(([0], ends, rest)).astype(np.int64)


def _cut_text(key, text: bytes, copies: int, rate: int, spm_rate: int, seed: int,
              piece_bytes: int) -> Iterator[tuple]:
    digest = hashlib.sha256(f"{seed}:{key[0] or ''}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    ends = _line_ends(text)
    n = len(ends) - 1
    if not text or any(m in text for m in RESTORED) or h3 % 100 >= rate:
        form, parts = "plain", [(b"", 0, n)]
        chars = (None, None)
    else:
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        form = "spm" if h4 % 100 < spm_rate else "psm"
        lines = {PREFIX: (0, low), MIDDLE: (low, high), SUFFIX: (high, n)}
        parts = [(marker, *lines[marker]) for marker in FORMS[form]]
        chars = tuple(len(text[ends[a]:ends[b]].decode("utf-8", "replace"))
                      for a, b in (lines[PREFIX], lines[MIDDLE]))
    seq = 0
    for marker, first, last in parts:
        for chunk in _chunks(text, ends[first:last + 1], piece_bytes):
            head = (copies, form, n, *chars) if seq == 0 else (0, None, None, None, None)
            yield (*key, seq, *head, marker + chunk)
            marker, seq = b"", seq + 1


def _chunks(text: bytes, ends: np.ndarray, size: int) -> Iterator[bytes]:
    """Runs of whole lines of at most ``size`` bytes; a longer line is cut by bytes."""
    at, stop = int(ends[0]), int(ends[-1])
    if at == stop:
        yield b""
    while at < stop:
        whole = int(ends[np.searchsorted(ends, at + size, side="right") - 1])
        upto = whole if whole > at else min(at + size, stop)
        yield text[at:upto]
        at = upto


class _Sections:
    """Finds the markers of an output that comes in pieces of any size."""

    def __init__(self, form: str):
        self.wanted = list(FORMS.get(form, ()))
        self.section, self.held = 0, b""

    def feed(self, data: bytes) -> Iterator[tuple[int, bytes]]:
        data = self.held + data
        while self.wanted:
            at = data.find(self.wanted[0])
            if at < 0:
                split = max(0, len(data) - len(self.wanted[0]) + 1)
                yield self.section, data[:split]
                self.held = data[split:]
                return
            yield self.section, data[:at]
            marker = self.wanted.pop(0)
            self.section, data = RESTORED[marker], data[at + len(marker):]
        self.held = b""
        yield self.section, data

    def rest(self) -> tuple[int, bytes]:
        return self.section, self.held


def _documents(batches: Iterator[pd.DataFrame], places: list[str]
               ) -> Iterator[tuple[str, tuple | None]]:
    """``("row", row)`` for every new place of a document, ``("end", None)`` after its last.

    Rows that repeat a place come as ``("again", row)``.
    """
    before = None
    for batch in batches:
        for row in batch.itertuples(index=False):
            key = (row.doc_key, row.text_md5)
            place = tuple(getattr(row, p) for p in places)
            if before is not None and before[0] != key:
                yield "end", None
            yield ("again" if before == (key, place) else "row"), row
            before = (key, place)
    if before is not None:
        yield "end", None


def _old_places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest every output and give its bytes the place they had in the text."""
    rows, size, head, copies = [], 0, None, 0
    for kind, row in _documents(batches, ["seq"]):
        if kind == "end":
            section, data = sections.rest()
            if data:
                rows.append((*key, section, seq, 0, *[None] * 5, data))
            rows.append((*key, -1, 0, copies, *head, digest.hexdigest(), b""))
            head = None
        else:
            if row.seq == 0:
                copies = (copies if kind == "again" else 0) + int(row.copies)
            if kind == "again":
                continue
            if head is None:
                key = (row.doc_key, row.text_md5)
                head = (row.form, *(None if pd.isna(v) else int(v)
                                    for v in (row.n, row.prefix_chars, row.middle_chars)))
                sections, digest, seq = _Sections(row.form), hashlib.sha256(), 0
            digest.update(row.piece)
            for section, data in sections.feed(row.piece):
                if data:
                    rows.append((*key, section, seq, 0, *[None] * 5, data))
                    seq, size = seq + 1, size + len(data)
        if size >= 64 * PIECE_BYTES or len(rows) >= 10_000:
            yield _frame(rows, OLD_PLACES)
            rows, size = [], 0
    if rows:
        yield _frame(rows, OLD_PLACES)


def restored(outputs: DataFrame) -> DataFrame:
    """The texts again, as pieces in their old order, from outputs as ``pieces`` gives them.

    Only the form and the bytes of an output are used. A row with ``section`` -1
    comes before the pieces of a document and holds what belongs to it as a whole.
    """
    return outputs.mapInPandas(_old_places, OLD_PLACES).sortWithinPartitions(
        *KEY, "section", "seq")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = []
    for kind, row in _documents(batches, ["section", "seq"]):
        if kind == "end":
            values = (head.doc_key, int(head.n), head.form, *(
                None if pd.isna(v) else int(v) for v in (head.prefix_chars, head.middle_chars)))
            for _ in range(int(head.copies)):
                rows.append((*values, head.output_sha256, digest.hexdigest()))
                if len(rows) >= 10_000:
                    yield _frame(rows, RESULT)
                    rows = []
        elif row.section == -1:
            head, digest = row, hashlib.sha256()
        else:
            digest.update(row.piece)
    if rows:
        yield _frame(rows, RESULT)


def digests(outputs: DataFrame) -> DataFrame:
    """One row per document: its form and counts, the SHA-256 of output and restored text.

    ``prefix_chars`` and ``middle_chars`` count code points and are NULL for plain
    texts. Repeated rows give a row each.
    """
    return _with_ids(restored(outputs).mapInPandas(_digests, RESULT))


def _with_ids(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_key").cast("long").alias("doc_id"), *df.columns[1:])


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, head, copies = [], None, 0
    for kind, row in _documents(batches, ["seq"]):
        if kind == "end":
            text = b"".join(held).decode("utf-8", "replace")
            yield _frame([(head.doc_key, int(head.n), head.form, text)] * copies, TEXTS)
            held, head = [], None
            continue
        if row.seq == 0:
            copies = (copies if kind == "again" else 0) + int(row.copies)
        if kind == "row":
            head = row if head is None else head
            held.append(row.piece)


def texts(outputs: DataFrame) -> DataFrame:
    """``doc_id, n, form, text``: every output as one text, one text at a time in memory."""
    return _with_ids(outputs.mapInPandas(_texts, TEXTS))


def transform(docs: DataFrame, **options) -> DataFrame:
    """The digests of all documents (see ``pieces`` and ``digests``)."""
    return digests(pieces(docs, **options))
