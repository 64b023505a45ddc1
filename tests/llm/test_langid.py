import math
import random
from collections import Counter

import numpy as np
import pytest

from capstrata.llm import langid

LANGS = {"xx": ["aba", "abo", "bab", "oba"], "yy": ["kik", "kek", "iki", "eki"], "zz": ["aki", "bok", "abik"]}


def docs(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(["", ". "]).join(rng.choice(LANGS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 30))), lang) for i in range(n) for lang in [rng.choice(list(LANGS))]]


def brute_tables(rows):
    counts = {}
    for _, text, lang in rows:
        if text and lang:
            for w in langid.words_of(text):
                counts.setdefault((lang, 0), Counter())[w] += 1
                for n in range(1, 5):
                    for g in langid.grams(w, n):
                        counts.setdefault((lang, n), Counter())[g] += 1
    return counts


@pytest.mark.parametrize("share", [0.0, 0.02])
def test_tables_equal_brute_force(frame, share, monkeypatch):
    monkeypatch.setattr(langid, "HELD", 7)
    rows = docs(60, 1) + [(900, None, "xx"), (901, "kik", None), (3, "aba", "xx")]
    model = langid.fit_languages(frame([(*r, 1) for r in rows], "doc_id long, text string, lang string, n int"), "text", "lang", share)
    counts = brute_tables(rows)
    totals = {k: sum(c.values()) for k, c in counts.items()}
    for size in range(5):
        want = {g for (lang, n), c in counts.items() if n == size for g, k in c.items() if k >= share * totals[lang, n]}
        assert set(model.tables[size]) == want
        for g in want:
            for i, lang in enumerate(model.langs):
                k = counts[lang, size][g]
                assert math.isclose(model.logs[model.tables[size][g]][i], math.log((k + langid.UNSEEN) / (totals[lang, size] + 1)), rel_tol=1e-5)
    assert model.langs == sorted(LANGS, key=lambda x: (-totals[x, 0], x))


def test_backoff_goes_from_long_to_short():
    model = langid.LanguageModel(["a", "b"], [{"word": 0}, {"x": 1}, {"_q": 2, "qx": 3}, {}, {"abcd": 4}], np.array([[1, 2], [3, 4], [5, 6], [7, 8], [9, 10]], np.float32))
    assert model.vector("word").tolist() == [1, 2] and model.vector("zabcdz").tolist() == [9, 10]
    assert model.vector("qx").tolist() == [6, 7] and model.vector("xy").tolist() == [3, 4] and model.vector("日").tolist() == [0, 0]


def test_rows_of_a_text_are_fetched_at_once():
    rng = np.random.default_rng(1)
    logs = rng.normal(size=(9, 2)).astype(np.float32)
    model = langid.LanguageModel(["a", "b"], [{"word": 0, "w": 1}, {"x": 2, "y": 3}, {"_q": 4, "qx": 5}, {"abc": 6}, {"abcd": 7, "bcd_": 8}], logs)
    known = {"word": [0], "w": [1], "qx": [4, 5], "xyx": [2, 3, 2], "abcd": [7, 8], "zabcz": [6], "日": []}
    assert {w: [model.tables[0][w]] if w in model.tables[0] else model.gram_rows(w) for w in known} == known
    counts, seen = Counter({w: i + 1 for i, w in enumerate(known)}), {}
    want = sum(n * logs[known[w]].mean(axis=0, dtype=float) for w, n in counts.items() if known[w])
    assert np.allclose(model.total(counts, seen), want, rtol=1e-5) and np.allclose(model.total(counts, seen), want, rtol=1e-5)
    assert set(seen) == set(known) - {"word", "w"}  # words of the model need no memory
    assert model.total(Counter(["日"]), seen).tolist() == [0, 0]


def test_held_out_accuracy_and_odd_texts(frame):
    train, test = docs(300, 2), docs(200, 3)
    model = langid.fit_languages(frame(train, "doc_id long, text string, lang string"), "text", "lang")
    odd = [(1000, None, "xx"), (1001, "", "xx"), (1002, "12 _ . ²!", "xx"), (1003, "日本語", "xx"), (1004, "aba " * 50000, "yy")]
    df = frame([(i, t, "never used", 5.0) for i, t, _ in test + odd], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in langid.identify(df, "text", model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in test) >= 0.97 * len(test)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert got[1003].lang_pred == model.langs[0] and got[1004].lang_pred == "xx"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nothing_learned(frame):
    model = langid.fit_languages(frame([(1, "text", None)], "doc_id long, text string, lang string"), "text", "lang")
    got = langid.identify(frame([(1, "some text")], "doc_id long, text string"), "text", model).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    assert langid.identify(frame([], "doc_id long, text string"), "text", model).collect() == []
