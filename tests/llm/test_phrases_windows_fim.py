"""Phrase mining, window dedup and fill-in-the-middle, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from vistrata.llm import fim, phrases, sketch, windowdedup
from vistrata.llm.wordhash import numbers

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def babble(rng: random.Random, n: int, vocabulary: int = 40) -> str:
    return " ".join(f"w{int(rng.expovariate(0.15)) % vocabulary}" for _ in range(n))


# ---------------------------------------------------------------- sketch


def keys_frame(spark, keys):
    return spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "k long")


def test_sketch_never_counts_too_low(spark):
    keys = numbers(3_000, 5)
    rows = keys_frame(spark, np.concatenate((keys, keys[:1_000], np.repeat(keys[:1], 40))))

    def of(batches):
        for batch in batches:
            yield batch["k"].to_numpy().view(np.uint64)

    for width in (sketch.BLOCK, 8 * sketch.BLOCK):
        table = sketch.count_sketch(rows.repartition(5), of, width, limit=2, high=40)
        assert table.reaches(keys[:1_000]).all()
        assert table.reaches(keys[1_000:]).mean() < 0.1
        assert table.reaches_high(keys[:1]).all()
        assert table.reaches_high(keys[1:]).mean() < 0.1


def test_sketch_of_nothing(spark):
    empty = spark.createDataFrame([], "k long")
    table = sketch.count_sketch(empty, lambda b: iter(()), sketch.BLOCK, limit=1)
    assert not table.reaches(numbers(10, 1)).any() and not table.high.any()


def test_width_is_bounded():
    assert sketch.width_for(0) == sketch.BLOCK
    assert sketch.width_for(10**15) == sketch.MAX_WIDTH


# ---------------------------------------------------------------- window dedup


def brute_windows(rows, size=13):
    first = {}
    split = [(i, WORDS.findall(t or "")) for i, t in rows]
    for i, ws in split:
        for k in range(len(ws) - size + 1):
            gram = tuple(ws[k:k + size])
            if i is not None:
                first[gram] = min(i, first.get(gram, i))
    out = []
    for i, ws in split:
        gone = set()
        for k in range(len(ws) - size + 1):
            least = first.get(tuple(ws[k:k + size]))
            if least is not None and (i is None or i > least):
                gone.update(range(k, k + size))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((i, len(ws), len(gone), sha(kept)))
    return sorted(out, key=str)


def windows_of(docs, **options):
    return sorted((tuple(r) for r in windowdedup.digests(docs, **options).collect()), key=str)


def test_windows_odd_rows(spark, frame, odd_rows):
    assert windows_of(frame(odd_rows)) == brute_windows([r[:2] for r in odd_rows])


def test_windows_shared_passages(frame):
    rng = random.Random(4)
    shared = [babble(rng, 30, 1_000) for _ in range(4)]
    rows = []
    for i in rng.sample(range(1_000), 120):
        parts = [babble(rng, rng.randrange(40), 1_000) for _ in range(3)]
        for s in rng.sample(shared, 2):
            parts.insert(rng.randrange(len(parts)), s[:rng.randrange(len(s))])
        rows.append((i, "\n".join(parts), "en", "s"))
    got = windows_of(frame(rows))
    assert got == brute_windows([r[:2] for r in rows]) and sum(r[2] for r in got) > 500


def test_windows_frequent_ones_by_aggregate(frame, monkeypatch):
    """Windows above the limit take the combined way, with the same result."""
    rng = random.Random(5)
    passage = babble(rng, 40, 1_000)
    rows = [(i, f"{babble(rng, 5, 1_000)} {passage} {i}", "en", "s") for i in range(90)]
    rows += [(200, passage, "en", "s"), (200, "other " + passage, "en", "s"),
             (None, passage, "en", "s")]
    want = brute_windows([r[:2] for r in rows])
    assert windows_of(frame(rows)) == want
    monkeypatch.setattr(windowdedup, "HOT", 20)
    assert windows_of(frame(rows)) == want


def test_windows_full_sketch_loses_nothing(frame, monkeypatch):
    """A sketch far too small lets everything through; the grouping is exact all the same."""
    rng = random.Random(6)
    text = babble(rng, 400, 30)
    rows = [(i, babble(rng, 50, 30) + " " + text[40 * i:40 * i + 300], "en", "s") for i in range(20)]
    want = brute_windows([r[:2] for r in rows])
    monkeypatch.setattr(sketch.Sketch, "reaches", lambda self, keys: np.ones(len(keys), bool))
    assert windows_of(frame(rows)) == want


def test_windows_kept_text_and_empty_table(frame):
    twice = " ".join(f"a{i}" for i in range(13))
    rows = [(1, "x " + twice, "", ""), (2, twice + "\n y", "", ""), (3, twice + " " + twice, "", "")]
    got = {r.doc_id: r.text for r in windowdedup.remove_repeats(frame(rows)).collect()}
    assert got == {1: "x " + twice, 2: "y", 3: ""}
    assert windowdedup.digests(frame([])).collect() == []


# ---------------------------------------------------------------- phrases


def brute_phrases(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for size in range(1, 5):
                for k in range(len(ws) - size + 1):
                    f[lang][tuple(ws[k:k + size])] += 1
    out = []
    for lang, counts in f.items():
        found = []
        for p, a in counts.items():
            if len(p) < 2 or a < least:
                continue
            longer = [c for q, c in counts.items() if len(q) > len(p) and c >= least
                      and any(q[k:k + len(p)] == p for k in range(len(q)))]
            if any(100 * c >= 80 * a for c in longer):
                continue
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def phrases_of(docs, **options):
    return sorted(tuple(r) for r in phrases.collocations(docs, **options).collect())


def test_phrases_against_counting(frame):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        parts = [babble(rng, rng.randrange(1, 30), 25) for _ in range(6)]
        parts.insert(2, "New  york\tcity Hall")
        text = "".join(p + rng.choice([". ", ",", "\n", " ", "!?", "\r\n", " \t "]) for p in parts)
        rows.append((i % 50, text, rng.choice(["en", "en", "dé", None]), "s"))
    got = phrases_of(frame(rows), least=5, top=40)
    assert got == brute_phrases([(r[2], r[1]) for r in rows], 5, 40)
    assert {r[0] for r in got} == {"en", "dé", "und"}
    assert any(r[2] == "new york city hall" for r in got)


def test_phrases_odd_rows(frame, odd_rows):
    got = phrases_of(frame(odd_rows), least=3, top=50)
    assert got == brute_phrases([(r[2], r[1]) for r in odd_rows], 3, 50)


def test_phrases_of_long_texts_cut_into_parts(frame, monkeypatch):
    rng = random.Random(9)
    text = ". ".join(babble(rng, 30, 12) for _ in range(40)) + " " + "x" * 700
    rows = [(1, text, "en", "s"), (2, text[:900], "en", "s"), (3, " \t " + text, "en", "s")]
    want = brute_phrases([(r[2], r[1]) for r in rows], 4, 100)
    for size in (64, 300):
        monkeypatch.setattr(phrases, "BLOCK_BYTES", size)
        assert [b for b in phrases._parts(phrases._GAPS.sub(b" ", text.encode()))]
        assert phrases_of(frame(rows), least=4, top=100) == want


def test_phrases_empty_table(frame):
    assert phrases.collocations(frame([])).collect() == []


def test_phrase_scores_are_exact_above_64_bits(spark):
    big = 3 * 10**15
    runs = spark.createDataFrame(
        [("en", 1, "a", big + 1), ("en", 1, "b", big + 2), ("en", 2, "a b", big),
         ("en", 0, "", 10 * big)], "lang string, size int, phrase string, n long")
    (row,) = phrases.scored(runs).collect()
    assert row.score == 2_000_000 * big // (2 * big + 3)


# ---------------------------------------------------------------- fill in the middle


def brute_fim(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = sha("7:" + ("" if doc_id is None else str(doc_id)))
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_rows(odd_rows):
    lines = "\n".join(f"line {i} é😀" + "x" * (i % 50) for i in range(300))
    return odd_rows + [
        (20 + i, lines[i * 7:i * 7 + 900], "en", "a") for i in range(30)] + [
        (60, "a<M>b\nc", "", ""), (61, "<", "", ""), (62, "<P\n><S\n\n", "", ""), (63, "\n\n\n", "", ""),
        (64, lines * 20, "", ""), (65, "é" * 5_000 + "\n" + "<M" * 400, "", ""), (-5, "x\ny", "", ""),
        (2**62 + 1, "a\nb\nc\n", "", "")]


@pytest.mark.parametrize("piece", [16, 1 << 16])
@pytest.mark.parametrize("rate", [100, 40])
def test_fim_round_trip(frame, odd_rows, piece, rate):
    rows = fim_rows(odd_rows)
    want = sorted((brute_fim(i, t, rate)[:5] + (sha(brute_fim(i, t, rate)[5]), sha(t or ""))
                   for i, t, _, _ in rows), key=str)
    got = fim.transform(frame(rows), piece_bytes=piece, rate=rate).collect()
    assert sorted((tuple(r) for r in got), key=str) == want


def test_fim_texts(frame, odd_rows):
    rows = fim_rows(odd_rows)
    got = fim.texts(fim.pieces(frame(rows), piece_bytes=100)).collect()
    want = [brute_fim(i, t) for i, t, _, _ in rows]
    assert sorted(((r.doc_id, r.n, r.form, r.text) for r in got), key=str) == sorted(
        ((*w[:3], w[5]) for w in want), key=str)


def test_fim_restores_from_the_output_alone(spark):
    """Pieces of any size, with markers across their borders, give the old order."""
    out = b"<S>tail <\n<P>head\n<M>mid<dle\n"
    for size in (1, 2, 3, 5, 100):
        sections = fim._Sections("spm")
        found = defaultdict(bytes)
        for k in range(0, len(out), size):
            for section, data in sections.feed(out[k:k + size]):
                found[section] += data
        section, data = sections.rest()
        found[section] += data
        assert b"".join(found[k] for k in sorted(found)) == b"head\nmid<dle\ntail <\n"


def test_fim_repeated_rows_over_partitions(frame):
    rows = [(1, "a\nb\nc", "", "")] * 7 + [(2, "", "", "")] * 3 + [(1, "other", "", "")]
    got = fim.transform(frame(rows).repartition(5)).collect()
    assert sorted((r.doc_id, r.restored_sha256) for r in got) == sorted(
        (i, sha(t)) for i, t, _, _ in rows)


def test_fim_empty_table(frame):
    assert fim.transform(frame([])).collect() == []
