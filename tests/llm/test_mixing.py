import math
from collections import Counter
from hashlib import md5

import pytest

from capstrata.llm import mixing


def unit(text):
    return (int(md5(text.encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)


def brute(rows, weights, default, seed):
    mass = Counter()
    for _, src, text in rows:
        mass[src] += len(text or "") + 1
    w = {s: weights.get(s, default) for s in mass}
    out = Counter()
    for i, src, _ in rows:
        rate = w[src] / sum(w.values()) * sum(mass.values()) / mass[src]
        parts = max(1, math.ceil(rate / 16))
        mean, n = rate / parts, 0
        for p in range(parts):
            u = unit(f"{seed}|{p}|{'null' if i is None else i}")
            total, term = 0.0, math.exp(-mean)
            for k in range(81):
                term = term * mean / k if k else term
                total += term
                n += total <= u
        for c in range(n):
            out[i, src, c] += 1
    return out


ROWS = [(i, ["a", "b", "c", None][i % 4] if i % 3 else "a", "w" * (i % 50)) for i in range(400)] + [(7, "a", None), (7, "a", None), (None, "b", "x"), (901, "tiny", "")]


@pytest.mark.parametrize("weights", [{"a": 1.0, "b": 5.0}, {"tiny": 3.0}, {"a": 0.0}])
def test_equals_brute_force(spark, frame, weights):
    df = frame([(*r, 1) for r in ROWS], "doc_id long, source string, text string, mix_copy int")
    got = mixing.mix_sources(df, "source", ["doc_id"], "text", weights, seed=5)
    assert got.columns == ["doc_id", "source", "text", "mix_copy", "mix_order"]
    assert Counter((r.doc_id, r.source, r.mix_copy) for r in got.collect()) == brute(ROWS, weights, 1.0, 5)


def test_shares_and_order(spark, frame):
    rows = [(i, "big" if i % 10 else "small", "t" * 9) for i in range(20000)]
    got = mixing.mix_sources(frame(rows, "doc_id long, source string, text string"), "source", ["doc_id"], "text", {"big": 3.0, "small": 1.0}, seed=1).collect()
    share = sum(r.source == "small" for r in got) / len(got)
    assert abs(share - 0.25) < 0.02 and abs(len(got) - 20000) < 700
    places = [r.mix_order for r in got]
    assert len(set(places)) == len(places)
    ids = [r.doc_id for r in got if r.source == "big"]
    up = sum(a < b for a, b in zip(ids, ids[1:]))
    assert 0.45 < up / len(ids) < 0.55


def test_empty(spark, frame):
    assert mixing.mix_sources(frame([], "doc_id long, source string, text string"), "source", ["doc_id"], "text", {}).collect() == []
    with pytest.raises(ValueError):
        mixing.mix_sources(frame([], "doc_id long, source string, text string"), "source", ["doc_id"], "text", {"a": -1})
