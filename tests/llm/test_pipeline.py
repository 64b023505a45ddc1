"""The pipeline, stage by stage, against brute force on the smallest tables."""
import math
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from capstrata.llm import linededup, quality
from capstrata.llm.queries import MIX_SEED, MIX_WEIGHTS
from capstrata.session import stage
from tests.llm import test_jaccard, test_linededup, test_mixing, test_quality

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no driver tables")


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    outs = []
    for _, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, DIR))
        outs.append([r.asDict() for r in docs.collect()])
    given = [r.asDict() for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    good, lines, single, mixed, packed = outs
    columns = set(given[0])
    assert all(set(r) == columns for o in outs[:4] for r in o)

    # quality rules: what the base rules reject goes, nothing is changed, and labelled documents are told apart
    base = {r["doc_id"]: test_quality.brute(r["text"]) for r in given}
    fails = {k for k, s in base.items() if s[0] < quality.MIN_WORDS or 100 * s[4] > quality.MAX_REPEAT_PERCENT * s[0]}
    kept = {r["doc_id"] for r in good}
    assert not kept & fails and all(r in given for r in good)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    passing = [k for k in labels if k not in fails]
    assert np.mean([(k in kept) == bool(labels[k]) for k in passing]) > 0.9

    # line dedup
    gone = test_linededup.brute([(r["doc_id"], r["text"]) for r in good], linededup.LineRule())
    want = {}
    for r in good:
        left = [x for i, x in enumerate(r["text"].split("\n")) if (r["doc_id"], r["text"], i) not in gone]
        if len(left) == len(r["text"].split("\n")) or any(x.strip() for x in left):
            want[r["doc_id"]] = "\n".join(left)
    assert {r["doc_id"]: r["text"] for r in lines} == want

    # near-duplicates: the smallest id of every group
    groups = test_jaccard.brute([(r["doc_id"], r["text"]) for r in lines], corpus_pipeline.NEAR_RULE)
    assert sorted(r["doc_id"] for r in single) == sorted(k for k, n, c in groups if k == c)

    # mixing
    want = test_mixing.brute([(r["doc_id"], r["source"], r["text"]) for r in single], MIX_WEIGHTS, 1.0, MIX_SEED)
    assert Counter(r["doc_id"] for r in mixed) == Counter(k for k, _, _ in want.elements())

    # packing: all pieces of all copies, gapless
    pieces = Counter((r["doc_id"], r["piece"]) for r in packed)
    assert all(pieces[k, 0] == n for k, n in Counter(r["doc_id"] for r in mixed).items())
    test_packing_layout = {}
    for r in packed:
        test_packing_layout.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in test_packing_layout.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 1024
    total = sum(r["length"] for r in packed)
    assert len(test_packing_layout) <= 1.05 * math.ceil(total / 1024) + 1


def test_run_gives_the_same_rows(spark):
    a = corpus_pipeline.run(spark, DIR)
    assert a.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and a.count() > 0
