import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from capstrata.llm import spelling
from capstrata.llm.queries import LLM_QUERIES
from capstrata.llm.spelling import FMIndex, SpellingRule

DIR = "/root/testdata/sf0.001"


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1:] == b[i + 1:] or a[i:] == b[i + 1:] or a[i + 1:] == b[i:]


def typed(docs):
    for key, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            yield w[:h % len(w)] + w[h % len(w) + 1:] if h % 97 == 0 else w


def brute(words, rule):
    n = {w: c for w, c in Counter(words).items() if len(w) >= rule.min_chars and c >= rule.min_count}
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    out, form = {}, {}
    for w, c in n.items():
        near = [x for m in (-1, 0, 1) for x in by_length.get(len(w) + m, []) if is_near(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= rule.ratio * c else None
        out[w] = (c, len(near))
    def root(w):
        return root(form[w]) if form[w] else w
    return sorted((w, form[w] or "", root(w), c, m, n[form[w]] if form[w] else -1) for w, (c, m) in out.items())


def result(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


@pytest.mark.parametrize("letters,count", [("ab", 40), ("abcdé", 60), ("a", 4), ("abcdefghijkl", 1)])
def test_search_finds_every_word_one_edit_away_and_no_other(letters, count):
    rng = random.Random(count)
    for _ in range(25):
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(5, 8))) for _ in range(count)})
        asked = sorted({"".join(rng.choice(letters + "$") for _ in range(rng.randint(5, 8))) for _ in range(20)} | set(words[:5]))
        index = FMIndex(words)
        for right in (True, False):
            exact = np.array([len(w) // 2 if right else -(-len(w) // 2) for w in asked])
            p, f = index.within_one(asked, exact, right)
            got = {(asked[i], words[j]) for i, j in zip(p.tolist(), f.tolist())}
            assert got == {(q, w) for q, e in zip(asked, exact.tolist()) for w in words if is_near(q, w) and (w[:e] == q[:e] if right else w[-e:] == q[-e:])}


@pytest.mark.parametrize("rule", [SpellingRule(), SpellingRule(shard=60), SpellingRule(min_chars=2, min_count=1, ratio=3, shard=500)])
def test_groups_equal_brute_force(frame, rule):
    rng = random.Random(7)
    base = ["".join(rng.choice("abc") for _ in range(rng.randint(4, 7))) for _ in range(60)] + ["zzzz" + "".join(rng.choice("ab") for _ in range(3)) for _ in range(12)] + ["über" * 3, "ÜBER" * 3, "x" * 4000, "x" * 4001]
    docs = [(i if i % 9 else None, " ".join(rng.choices(base, weights=range(len(base), 0, -1), k=40)) + "\n×÷ A1B2 " + base[-1]) for i in range(60)] + [(99, None), (98, ""), (97, "1 2")] + [(5, "same same")] * 3
    df = frame([(k, t, "n", 1) for k, t in docs], "doc_id long, text string, n string, `word` int")
    got = spelling.group_variants(spelling.with_slips(spelling.runs(df, "doc_id", "text")), rule)
    assert result(got) == brute(typed(docs), rule)


@pytest.mark.skipif(not Path(DIR).exists(), reason="no driver tables")
def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert result(LLM_QUERIES["op12_spelling_variants"](spark, DIR)) == brute(typed(docs), SpellingRule())


def test_hot_half_is_dealt_out_in_parts(frame):
    words = frame([(f"stem{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}", 3) for i in range(676)], "word string, n long")
    shards = spelling.routed(words, SpellingRule(shard=400))
    heavy = shards.where("heavy = 'ste' and not asks").groupBy("part").count().collect()
    assert len(heavy) > 5 and max(r["count"] for r in heavy) < 150


def test_empty_and_null_words(frame):
    assert spelling.group_variants(frame([], "word string")).collect() == []
    assert result(spelling.group_variants(frame([(None,)] * 5 + [("hello",)] * 3 + [("hallo",)] * 7 + [("hulloo",)] * 2, "word string"))) == [("hallo", "", "hallo", 7, 1, -1), ("hello", "hallo", "hallo", 3, 1, 7)]
