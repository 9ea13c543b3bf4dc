"""The pipeline stage by stage, each on what its predecessor kept, against brute force."""

import hashlib
import os
import re
from collections import Counter

import pytest

import corpus_pipeline
from vistrata.llm.queries import piece_model
from vistrata.plans.session import materialise

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")


def test_stages(spark):
    import sentencepiece

    from tests.llm.test_exact import brute_counts, brute_targets, lower
    from tests.llm.test_learned import brute_classes, hashed_idf

    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs, seen = documents, []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF_DIR), "stage")
        seen.append((name, docs, docs.collect()))
    for _, frame, _ in seen[:-1]:
        assert frame.columns == documents.columns
    (_, ruled_frame, ruled), (_, exact_frame, exact), (_, _, near), (_, _, mixed), (_, _, coded) = seen

    def passes(r):
        n, _, _, _, repeated = brute_counts(r.text)
        return n >= 50 and 100 * repeated <= 50 * n
    # So few labels certify no cutoff: the base rules decide.
    assert sorted(ruled) == sorted(r for r in documents.collect() if passes(r))

    best = {}
    for r in ruled:
        key = lower(r.text)
        best[key] = max(best.get(key, r), r, key=lambda x: x.doc_id)
    assert sorted(exact) == sorted(best.values())

    rows = sorted((r.doc_id, r.text) for r in exact)
    classes = brute_classes(rows, hashed_idf(spark, exact_frame))
    assert sorted(r.doc_id for r in near) == sorted({rows[c][0] for c in classes})

    sizes, longest = Counter(), Counter()
    for r in near:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        sizes[r.source] += n
        longest[r.source] = max(longest[r.source], n)
    taken, copies = Counter(), Counter(mixed)
    for r, n in copies.items():
        assert n <= 3 and r in set(near)
        taken[r.source] += n * len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    for s, target in brute_targets(dict(sizes)).items():
        assert abs(taken[s] - target) <= longest[s]

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter()
    for r in mixed:
        ids = library.encode(r.text)
        want[r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))] += 1
    assert Counter(map(tuple, coded)) == want


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF_DIR), "stage")
    assert docs.count() == 0
