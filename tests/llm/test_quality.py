import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from capstrata.llm import quality, wordhash
from capstrata.session import stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, where = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            where |= {i + j for i in at for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(where),
            len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text)), len(re.findall("[!?]", text))]


TEXTS = ["", None, " ", "\n", "a", "a b c a b c", "a b c\na b c\n\na b c", "é ß x\x0by", "\n\n x \n x", "x" * 5000, "A b! " * 900, "日本 語# *|", "a\r\nb\r\na\r\nb"]


def counted(texts):
    parts = [quality.count_rules(t) for _, t in wordhash.slices(pa.array(texts, pa.string()))]
    return np.column_stack([np.concatenate([p[s] for p in parts]) for s in quality.STATISTICS]).tolist()


def test_counts_equal_brute_force(monkeypatch):
    rng = random.Random(0)
    texts = TEXTS + ["".join(rng.choice("ab  \n#!É\t") for _ in range(rng.randint(0, 120))) for _ in range(400)]
    assert counted(texts) == [brute(t) for t in texts]
    monkeypatch.setattr(wordhash, "SLICE_BYTES", 64)
    assert counted(texts) == [brute(t) for t in texts]
    sliced = pa.array(texts, pa.string()).slice(3, 9)
    assert sum(t.n for _, t in wordhash.slices(sliced)) == 9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\t#é", max_size=40), max_size=6))
def test_counts_property(texts):
    if texts:
        assert counted(texts) == [brute(t) for t in texts]


def make(rng, bad):
    w = ["".join(rng.choice("abcdeimnorst") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(60, 200))]
    return " ".join(x + rng.choice(["***", "$$$", "&&"]) for x in w) if bad else " ".join(w) + "."


def test_forest_rejects_rare_junk(spark, frame):
    rng = random.Random(2)
    docs = [(i, make(rng, i % 25 == 0), i % 25 != 0, "x") for i in range(1500)] + [(5000, None, True, "x"), (5001, "short", True, "x"), (3, make(rng, False), True, "x")]
    df = frame([(d[0], d[1], d[3]) for d in docs], "doc_id long, text string, kept string")
    labels = frame([(d[0], int(d[2])) for d in docs if d[0] % 3 == 0] + [(None, 1), (4, None)], "doc_id long, quality int")
    stats = stage(quality.rule_statistics(df, "text").drop("text"))
    model = quality.fit_quality(stats, labels, "doc_id", "quality", n_trees=60, rows_per_tree=64)
    got = {r.doc_id: r for r in quality.judge(stats, model).collect()}
    good = [got[i].kept for i in range(1500) if i % 25]
    assert np.mean(good) > 0.97 and not any(got[i].kept for i in range(0, 1500, 25))
    assert got[5000].base_failed and got[5001].base_failed and not got[5000].kept
    kept = quality.keep_good(df, "text", model)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([i for i in got if got[i].kept] + [3])


def test_without_labels_or_rows(spark, frame):
    rng = random.Random(1)
    df = frame([(i, make(rng, i == 0)) for i in range(30)], "doc_id long, text string")
    stats = stage(quality.rule_statistics(df, "text"))
    none = frame([], "doc_id long, quality int")
    assert quality.keep_good(df, "text", quality.fit_quality(stats, none, "doc_id", "quality", 5, 16)).count() == 30
    empty = stage(quality.rule_statistics(df.where("doc_id < 0"), "text"))
    model = quality.fit_quality(empty, none, "doc_id", "quality", 5, 16)
    assert quality.judge(empty, model).count() == 0
    named = quality.keep_good(df.withColumn("N_words", F.lit(7)), "text", model)  # a statistic's name is no obstacle
    assert named.columns == ["doc_id", "text", "N_words"] and {r[2] for r in named.collect()} == {7} and named.count() == 30
