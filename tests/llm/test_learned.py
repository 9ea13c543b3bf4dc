"""Operators that learn or sample: held-out accuracy, brute force and edge rows."""

import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from vistrata.llm import classifier, components, extract, langid, neardup

SF_DIR = "/root/testdata/sf0.01"
real = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")


def load(spark, name):
    return spark.read.parquet(f"{SF_DIR}/{name}.parquet")


# ---------------------------------------------------------------- near-duplicates


def brute_classes(rows, idf_of, least=0.8):
    """Classes by weighted Jaccard similarity over all pairs that share a run."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", neardup_lower(text or ""))
        runs = [tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else (
            [tuple(w)] if w else [])
        weights = defaultdict(float)
        for run in runs:
            weights[run] += sum(idf_of(x) for x in run) / len(run)
        sets.append(weights)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    near = defaultdict(list)
    for i, s in enumerate(sets):
        for run in s:
            near[run].append(i)
    for a, b in {(x, y) for v in near.values() for x in v for y in v if x < y}:
        both = sum(min(sets[a][r], sets[b][r]) for r in sets[a].keys() & sets[b].keys())
        if both / (sum(sets[a].values()) + sum(sets[b].values()) - both) >= least:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(len(rows))]


def neardup_lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def hashed_idf(spark, docs):
    table, sampler = neardup.document_frequencies(docs), neardup.Sampler()

    def idf(word):
        hashes, _ = sampler.words([word.encode()])
        return float(table[int(hashes[0]) >> 44])
    return idf


@real
def test_near_duplicates_of_the_documents(spark):
    docs = load(spark, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    want = brute_classes(rows, hashed_idf(spark, docs))
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    wrong = [i for (i, _), c in zip(rows, want) if got[i].class_id != rows[c][0]]
    assert len(wrong) <= 1  # bands miss a pair at the threshold once in a thousand
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.values())


def test_large_groups_and_odd_rows(spark, frame, odd_rows):
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(200)]
    rows = []
    for i in range(120):  # near copies of one text, copies of another, texts of their own
        edited = list(base)
        edited[rng.randrange(200)] = f"edit{i}"
        rows.append((100 + i, " ".join(edited), "", ""))
        rows.append((400 + i, " ".join(base[::-1]), "", ""))
        rows.append((700 + i, " ".join(f"own{i}x{j}" for j in range(30)), "", ""))
    docs = frame(rows + odd_rows)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows) + len(odd_rows)
    by_id = {r.doc_id: r for r in got}
    assert {by_id[100 + i].class_id for i in range(120)} == {100}
    assert by_id[400].class_size == 120 and by_id[400].n_links == 0
    assert all(by_id[700 + i].class_id == 700 + i for i in range(120))
    assert by_id[2].class_id == by_id[3].class_id == 1  # A-Z in either case
    assert [r.kept for r in got if r.doc_id in (4, 5, 6)] == [True] * 3
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in got)
    assert neardup.near_duplicates(frame([])).collect() == []


def test_samples_agree_as_often_as_the_similarity(monkeypatch):
    rng = np.random.default_rng(5)
    sampler = neardup.Sampler()
    runs = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    runs.sort()
    a, b = rng.uniform(1, 9, 300), rng.uniform(1, 9, 300)
    b[:100] = a[:100]
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    hits, n = 0, 0
    monkeypatch.setattr(neardup, "ROWS", 1)
    for seed in range(60):
        sampler.seeds = neardup.numbers(60, 100 + seed) | np.uint64(1)
        x, y = (sampler.bands(runs, w, np.array([300])) for w in (a, b))
        hits, n = hits + int((x == y).sum()), n + x.size
    assert abs(hits / n - want) < 5 * (want * (1 - want) / n) ** 0.5


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)]
    links += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components.components(frame).collect()}
    root = {i: i for link in links for i in link}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert {i: got.get(i, i) for i in root} == {i: find(i) for i in root}
    assert components.components(frame.limit(0)).collect() == []


# ---------------------------------------------------------------- languages


@real
def test_languages_of_held_out_documents(spark):
    docs = load(spark, "documents")
    got = langid.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 150 and (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


@real
def test_a_mixed_text_shows_its_languages(spark, frame):
    docs = load(spark, "documents")
    langs, logs = langid.fit(docs)
    parts = {r.lang: r.text for r in docs.filter("length(text) > 1500").dropDuplicates(
        ["lang"]).collect()}
    text = parts["de"][:1200] + " " + parts["fr"][:600]
    row = langid.identify(frame([(1, text, None, None)]), langs, logs).first()
    assert row.lang_pred == "de" and row.languages[:2] == ["de", "fr"] and 0.5 < row.score < 0.85


def test_rare_languages_of_a_large_table_are_learned(spark):
    docs = spark.range(45_000).selectExpr(
        "id AS doc_id", "concat('some text ', id) AS text",
        "CASE WHEN id % 4500 = 7 THEN concat('rare', id) ELSE 'en' END AS lang")
    langs, logs = langid.fit(docs)
    assert len(langs) == 11 and logs.shape == (langid.BUCKETS, 11)


def test_language_edges(spark, frame, odd_rows):
    got = langid.predict(frame(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    und = {r.doc_id for r in got if r.lang_pred == "und" and r.score == 0}
    assert {4, 5, 6} <= und and 1 not in und
    nameless = frame([(1, "text", None, "s")])
    assert langid.predict(nameless).first().lang_pred == "und"
    assert langid.predict(frame([])).collect() == []


# ---------------------------------------------------------------- quality classifier


@real
def test_quality_of_held_out_documents(spark):
    docs, labels = load(spark, "documents"), load(spark, "labels")
    got = classifier.predict(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    auc = np.mean([(good > x).mean() + (good == x).mean() / 2 for x in bad])
    assert auc > 0.97 and (held.predicted == held.quality).mean() > 0.93


def test_linear_time_equals_pairs():
    rng = np.random.default_rng(1)
    machine = classifier.Machine()
    machine.w = rng.normal(size=len(machine.w)).astype(np.float32)
    buckets, counts = np.array([3, 9, 70, 5]), np.array([3, 0, 1])
    stats = rng.normal(size=(3, len(classifier.STATISTICS)))
    got = machine.scores(buckets, counts, stats)
    for row, own in enumerate((buckets[:3], buckets[:0], buckets[3:])):
        x = {int(b): classifier.WORD_WEIGHT / max(1, len(own)) ** 0.5 for b in own}
        x |= {classifier.WORD_BUCKETS + j: v for j, v in enumerate(stats[row])}
        z = sum(machine.w[i] * v for i, v in x.items())
        z += sum(machine.v[i] @ machine.v[j] * x[i] * x[j] for i in x for j in x if i < j)
        assert got[row] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-4)


def test_classifier_edges(spark, frame, odd_rows):
    labels = spark.createDataFrame([(1, 1), (3, None), (5, 0), (None, 1)],
                                   "doc_id long, quality int")
    got = classifier.predict(frame(odd_rows), labels).collect()
    assert len(got) == len(odd_rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert classifier.predict(frame([]), labels).collect() == []
    none = classifier.predict(frame(odd_rows), labels.limit(0)).collect()
    assert len(none) == len(odd_rows)


# ---------------------------------------------------------------- pages


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body>
<nav><a href="/">Home</a></nav><div class="cookie-notice"><p>We use cookies</p></div>
<article><h1>The &quot;title&quot;</h1><p>First  <b>bold</b>
line &amp; more</p><aside>Read this too</aside><p>Second &lt;x&gt;<br>here</p>
<form>name <input></form><ul><li>one</li><li>two words</li></ul></article>
<section id="comments"><p>Nice post, says a reader with many many words</p></section>
<footer>&copy; someone</footer></body></html>"""
TEXT = 'The "title"\nFirst bold line & more\nSecond <x> here\none\ntwo words'


def test_a_page_and_a_page_without_labels(spark):
    plain = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    rows = [(1, "u", PAGE, "x"), (2, "u", plain, "x"), (3, None, None, "x"), (4, "u", "", "x"),
            (5, "u", "<p", "x"), (6, "u", "a < b &am", "x"), (None, None, PAGE, "x"),
            (7, "u", "<p>" + "long text " * 50_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in extract.main_texts(pages).collect()}
    assert got[1].text == got[2].text == got[None].text == TEXT
    assert got[3].text == got[4].text == got[5].text == ""
    assert got[6].text == "a < b &am"
    assert got[7].n_chars == 50_000 * 10 - 1
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert extract.main_texts(pages.limit(0)).collect() == []


def test_names_leave_no_article_out():
    body = "<h1>Title</h1><p>" + "some words of the text " * 20 + "</p>"
    rest = '<div class="comments"><p>' + "a reader says so " * 10 + "</p></div>"
    pages = [
        f'<body><article class="post hentry category-social">{body}</article>{rest}</body>',
        f'<body><article class="ad" id="share">{body}</article>{rest}</body>',
        f'<body><div class="page has-sidebar"><main>{body}</main></div>{rest}</body>',
        f'<body><div class="widget"><article>{body}</article></div>{rest}</body>',
        f'<body><form id="all"><article>{body}</article></form>{rest}</body>',
        f'<body><article><section id="related-work">{body}</section></article>{rest}</body>',
        f'<body><article><div class="social">{body}</div></article>{rest}</body>',
        f'<body><div data-id="ad" title="x class=ad y">{body}</div>{rest}</body>',
        f'<body><div class="sidebar">{body}</div></body>',
    ]
    want = "Title\n" + " ".join(["some words of the text"] * 20)
    counts = [extract.count_features(p) for p in pages]
    assert all(counts[:7]) and not any(counts[7:])
    total = sum(counts, counts[0].__class__())
    weights = extract.learned_weights([(f, inside, n) for (f, inside), n in total.items()])
    assert weights["named comments"] < 0 < weights["named social"]
    for learned in (weights, {k: v for k, v in weights.items() if not k.startswith("named")}):
        assert [extract.extract(p, learned) for p in pages] == [want] * len(pages)


def test_whole_names_are_listed():
    for yes in ('class="x ad"', "id=comments", 'class="cookie-notice"', "role='search'"):
        assert extract.listed_name(yes)
    for no in ('class="category-social has-sidebar"', 'id="related-work"', 'data-id="ad"',
               'aria-grid="menu"', 'title="class=ad"', 'class="" id', 'role="ad"', "class=adé"):
        assert not extract.listed_name(no), no


def test_best_region_is_the_best():
    rng = random.Random(4)
    for _ in range(500):
        scores = [rng.randrange(-5, 6) for _ in range(rng.randrange(1, 25))]
        low, high = extract.best_region(scores)
        best = max(sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1))
        assert sum(scores[low:high]) == max(0, best)


@real
def test_main_texts_of_the_pages(spark):
    pages = load(spark, "pages")
    got = {r.page_id: r.text for r in extract.main_texts(pages).collect()}
    import html
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        blocks = re.split(r"</?(?:h1|p)>", inner.replace("<b>", "").replace("<br>", " "))
        lines = (" ".join(html.unescape(b).split()) for b in blocks)
        assert got[r.page_id] == "\n".join(x for x in lines if x)
