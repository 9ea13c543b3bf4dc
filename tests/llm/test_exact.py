"""Operators with an exact answer, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from vistrata.llm import exactdedup, mixing, pieces, quality, suffixdedup, urlfilter
from vistrata.llm.lyndon import suffix_array
from vistrata.plans.session import scratch_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text)


# ---------------------------------------------------------------- exact duplicates


def test_verdicts(spark, frame, odd_rows):
    got = exactdedup.verdicts(frame(odd_rows), exactdedup.new_index(spark)).collect()
    groups = defaultdict(list)
    for i, t, _, _ in odd_rows:
        groups[sha(lower(t or ""))].append(i)
    assert len(got) == len(odd_rows)
    kept = Counter()
    for r in got:
        ids = groups[r.text_sha256]
        assert r.doc_id in ids and r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}


def test_drop_copies_keeps_columns_and_one_row(spark, frame, odd_rows):
    docs = frame(odd_rows)
    out = exactdedup.drop_copies(docs, exactdedup.new_index(spark))
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted(sha(lower(r.text or "")) for r in rows) == sorted(
        {sha(lower(t or "")) for _, t, _, _ in odd_rows})


def test_index_persists_and_grows(spark, frame):
    folder = scratch_path(spark, "index")
    first = exactdedup.DigestIndex(spark, folder, 4)
    exactdedup.verdicts(frame([(1, "a", "", ""), (2, "b", "", "")]), first)
    spark.sql(f"DROP TABLE {first.name}")  # as in another session
    again = exactdedup.DigestIndex(spark, folder, 4)
    got = {r.doc_id: (r.kept, r.keep_id) for r in exactdedup.verdicts(
        frame([(3, "A", "", ""), (4, "c", "", "")]), again).collect()}
    assert got == {3: (False, 1), 4: (True, 4)}
    assert again.table().count() == 3


def test_hot_groups_meet_by_broadcast(spark, frame):
    rows = [(i, "same" if i % 3 else f"own {i}", "", "") for i in range(3000)]
    got = exactdedup.verdicts(frame(rows), exactdedup.new_index(spark)).collect()
    assert len(got) == 3000 and sum(r.kept for r in got) == 1001


@pytest.mark.parametrize("run", [
    lambda s, d: exactdedup.verdicts(d, exactdedup.new_index(s)),
    lambda s, d: mixing.taken_words(d),
    lambda s, d: suffixdedup.remove_repeats(d),
    lambda s, d: quality.judge(d, s.createDataFrame([], "doc_id long, quality int")),
])
def test_empty_tables(spark, frame, run):
    assert run(spark, frame([])).collect() == []


# ---------------------------------------------------------------- URL rules


def brute_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = lower(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    fits = [(-len(h + p), h + p, v != "block", v) for h, p, v in rules
            if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, min(fits)[1] if fits else None, min(fits)[3] if fits else "allow"


@pytest.mark.parametrize("limit", [100, 0])
def test_url_rules(spark, limit):
    rng = random.Random(5)
    rules = urlfilter.BASE_RULES + [("a.b.net", "", "allow"), ("b.net", "/é", "block")]
    urls = [None, "", "nothing", "http://", "http://net", "http://NET/", "x://y.net?q/",
            "http://org/fr/../", "https://a..b.net/é/x#y", "http://www.example.net/en/1?x"]
    urls += [f"http://{rng.choice(['', 'www.', 'a.b.'])}"
             f"{rng.choice(['net', 'example.net', 'example.com', 'org', 'b.net', 'xnet'])}"
             f"{rng.choice(['/', '/en/', '/de/x', '/fr/', '/en', '', '/é'])}"
             f"{rng.choice(['', '?a=/b', '#c'])}" for _ in range(200)]
    rows = [(i, u, "p", "h") for i, u in enumerate(urls)] + [(None, urls[6], "", "")] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, prefix string, host string")
    got = urlfilter.judge(pages, urlfilter.rule_table(spark, rules), broadcast_rules=limit)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(
        ((i, *brute_rule(u, rules)) for i, u, _, _ in rows), key=key)


# ---------------------------------------------------------------- quality rules


def brute_counts(text):
    text = text or ""
    w = WORDS.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1
               for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered))


def test_counts_of_words_lines_and_windows(spark, frame, odd_rows):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \n$#é\t") for _ in range(rng.randrange(120)))
             for _ in range(150)]
    rows = odd_rows + [(100 + i, t, "en", "s") for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, quality int")
    got = quality.judge(frame(rows), labels).collect()
    assert len(got) == len(rows)
    want = Counter((i, *brute_counts(t)) for i, t, _, _ in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines,
                    r.n_repeat_words) for r in got) == want
    for r in got:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)


def test_binomial_tail_is_exact(spark):
    from math import comb

    from pyspark.sql import functions as F

    rows = [(k, n) for n in (1, 30, 400) for k in range(0, 6)]
    got = spark.createDataFrame(rows, "k long, n long").select(
        "k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.03).alias("p")).collect()
    for r in got:
        want = 1.0 if r.k >= r.n * 0.03 else sum(
            comb(r.n, i) * 0.03 ** i * 0.97 ** (r.n - i) for i in range(r.k + 1))
        assert r.p == pytest.approx(want, rel=1e-9)


def test_certified_rule_rejects_symbols_and_keeps_the_good(spark, frame):
    clean = " ".join(f"w{i}" for i in range(60))
    junk = " ".join(f"w{i}$$$" for i in range(60))
    rows = [(i, clean if i % 4 else junk, "en" if i < 1600 else None, "s") for i in range(2400)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(2000)],
                                   "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality.judge(frame(rows), labels).collect()}
    # 300 good labels certify nothing at this risk: the stratum without a language keeps all.
    assert all(got[i] == (i % 4 > 0 or i >= 1600) for i in range(2400))
    kept = quality.keep_good(frame(rows), labels)
    assert kept.columns == frame([]).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


# ---------------------------------------------------------------- mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    open_, out, left = set(names), {}, sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mix_meets_targets(spark, frame):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(0, 40), "en", rng.choice(["a", "b", "b", "b", "é", None, "z"]))
            for i in range(1500)] + [(9999, "w " * 30, "en", "b")] * 60
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    want = brute_targets(dict(sizes))
    got = mixing.taken_words(frame(rows)).collect()
    assert len(got) == len(rows)
    source = {i: s for i, _, _, s in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 40
    again = mixing.taken_words(frame(rows[::-1]).repartition(5)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    out = mixing.mixed(frame(rows))
    assert out.columns == frame([]).columns
    words = Counter()
    for r in out.collect():
        words[r.source] += len(r.text.split())
    assert words == taken


def test_mix_with_odd_rows(frame, odd_rows):
    got = mixing.taken_words(frame(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    assert sum(r.size for r in got) == sum(len(WORDS.findall(t or "")) for _, t, _, _ in odd_rows)


# ---------------------------------------------------------------- SentencePiece


@pytest.fixture(scope="module")
def model():
    import public_tokenizers
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepiece.SentencePieceProcessor(model_file=path), pieces.load_vocabulary(path)


def test_codes_as_the_library(spark, frame, odd_rows, model):
    library, vocabulary = model
    rng = random.Random(3)
    signs = " \n\t▁aethinsr.,'\"0日本é😀́\x00<>s_-=#  "
    texts = ["".join(rng.choice(signs) for _ in range(rng.choice([1, 3, 9, 60])))
             for _ in range(400)] + [" " * n + "word" + " " * n for n in range(20)]
    rows = odd_rows + [(100 + i, t, "", "") for i, t in enumerate(texts)]
    want = Counter()
    for i, t, _, _ in rows:
        ids = library.encode(t or "")
        want[i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))] += 1
    got = Counter(map(tuple, pieces.round_trips(frame(rows), vocabulary).collect()))
    assert got == want
    coded = pieces.encode_documents(frame(rows), vocabulary)
    back = Counter(map(tuple, pieces.decode_documents(coded, vocabulary).collect()))
    assert back == Counter((i, library.decode(library.encode(t or ""))) for i, t, _, _ in rows)


def test_backtracking_agrees_with_merging(model):
    coder = pieces.PieceCoder(model[1])
    rng = random.Random(8)
    known = list(coder.tokens)
    for _ in range(2000):
        word = "".join(rng.choice(known).strip("▁") for _ in range(rng.randrange(1, 6)))
        if word:
            assert coder.backtrack(word) == coder.merge(word)


# ---------------------------------------------------------------- repeated bytes


def test_suffix_arrays():
    rng = random.Random(1)
    for i in range(1500):
        letters = rng.choice([b"ab", b"abc", b"a", bytes(range(97, 110))])
        text = bytes(rng.choice(letters) for _ in range(rng.randrange(40))) * rng.randrange(1, 4)
        assert suffix_array(text) == sorted(range(len(text)), key=lambda j: text[j:])


def brute_removal(texts):
    seen = Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        yield len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("group_contexts", [20_000, 1])
def test_repeated_bytes(spark, frame, odd_rows, group_contexts):
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [noise(n) for n in (199, 200, 201, 260, 700)]
    rows = list(odd_rows)
    for i in range(60):
        parts = [noise(rng.randrange(400)) for _ in range(3)]
        whole = parts[0] + rng.choice(shared) + parts[1] + rng.choice(shared) + parts[2]
        rows.append((100 + i, whole, "", ""))
        if i % 7 == 0:  # a near copy, and parts of a passage that meet others
            rows.append((200 + i, whole[:90] + "X" + whole[91:], "", ""))
            rows.append((300 + i, shared[4][rng.randrange(400):] + noise(50) + shared[4][:350], "", ""))
    rows.append((400, "ab" * 400, "", ""))
    rows.append((7, "another text with the id of a short one " * 9, "", ""))
    want = Counter((r[0], *b) for r, b in zip(
        rows, brute_removal([(r[1] or "").encode() for r in rows])))
    got = suffixdedup.remove_repeats(frame(rows), group_contexts=group_contexts)
    assert Counter(map(tuple, got.collect())) == want


def context_row(gram, key, text, place):
    first = max(0, place - suffixdedup.LEFT)
    return gram, key, first, place - first, 1, text[first:place + suffixdedup.WINDOW]


def test_contexts_known_as_a_whole_are_not_sorted(monkeypatch):
    rng = random.Random(4)
    shared = bytes(rng.choice(b"abcdefgh") for _ in range(330))
    own = lambda i, n: b"%d" % i * n
    # Two contexts share 260 bytes; of three, each two share other bytes about the anchor.
    pair = [own(i, 100) + shared[:260] + own(i, 100) for i in (0, 1)]
    three = [own(i, 60) + shared[a:b] + own(i, 60)
             for i, (a, b) in zip((5, 6, 7), ((0, 240), (30, 300), (70, 330)))]
    rows = [context_row(1, b"%d" % i, t, 200) for i, t in enumerate(pair)]
    more = [context_row(2, b"%d" % (5 + i), t, 60 + 130 - a)
            for i, (t, a) in enumerate(zip(three, (0, 30, 70)))]
    sizes = []
    sort = suffixdedup.suffix_array
    monkeypatch.setattr(suffixdedup, "suffix_array", lambda t: sizes.append(len(t)) or sort(t))
    found = suffixdedup._sorted_spans(rows)
    assert sorted(map(tuple, found.values.tolist())) == [(b"0", 100, 360), (b"1", 100, 360)]
    assert not sizes
    both = suffixdedup._sorted_spans(rows + more).values.tolist()
    assert sorted(map(tuple, both)) == [
        (b"0", 100, 360), (b"1", 100, 360), (b"5", 90, 300), (b"6", 60, 330), (b"7", 60, 290)]
    assert len(sizes) == 1 and sizes[0] <= sum(len(r[-1]) + 1 for r in more)


def test_anchors_of_long_texts_do_not_depend_on_segments(monkeypatch):
    rng = random.Random(9)
    text = bytes(rng.choice(b"abcd") for _ in range(5000))
    whole = [x.tolist() for x in suffixdedup.Anchors().of(text)]
    monkeypatch.setattr(suffixdedup, "SEGMENT", 700)
    assert [x.tolist() for x in suffixdedup.Anchors().of(text)] == whole
