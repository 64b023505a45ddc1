import random
import re

import pytest

from capstrata.llm import jaccard
from capstrata.llm.jaccard import JaccardRule


def brute(rows, rule):
    sets = []
    for _, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "") if rule.lower else text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        sets.append({tuple(w[i:i + rule.words]) for i in range(len(w) - rule.words + 1)} if len(w) >= rule.words else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and rule.den * both >= rule.num * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k, len(sets[i]), least.get(find(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)), key=repr)


def result(frame, rows, rule):
    df = frame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, n int, component_id int")
    return sorted(((r[0], r[1], r[2]) for r in jaccard.jaccard_components(df, "doc_id", "text", rule).collect()), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    passages = [[rng.choice(vocab) for _ in range(30)] for _ in range(4)]
    texts = []
    for _ in range(40):
        texts.append([rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 20, 60]))])
    for _ in range(60):  # near copies of earlier texts, from one edit up to many
        t = list(rng.choice(texts))
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        if rng.random() < 0.4:
            t.insert(rng.randrange(len(t) + 1), rng.choice(vocab))
        texts.append(t)
    for _ in range(25):
        texts.append(rng.choice(passages) + rng.choice(passages)[:rng.randint(0, 30)] + [rng.choice(vocab) for _ in range(rng.randint(0, 6))])
    base = [rng.choice(vocab) + str(i) for i in range(80)]
    for i in range(40):  # a large group of copies, some only linked through others
        t = list(base)
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(80)] = f"e{rng.randint(0, 99)}"
        texts.append(t)
    rows = [(100 - i if i < 100 else i, " ".join(t) if i % 3 else " ".join(t).upper().replace(" ", "\n ", 1)) for i, t in enumerate(texts)]
    return rows + [(500, None), (501, ""), (502, " \t\n"), (503, "É"), (504, "é"), (7, rows[7][1]), (9, "other text of a repeated key"), (None, rows[3][1]), (None, "alone with no key at all")]


@pytest.mark.parametrize("seed,rule", [(0, JaccardRule(4, 85)), (1, JaccardRule(5, 80)), (2, JaccardRule(1, 60)), (3, JaccardRule(2, 100, 100, False))])
def test_equals_brute_force(frame, seed, rule):
    rows = corpus(seed)
    assert result(frame, rows, rule) == brute(rows, rule)


def test_last_round_alone_finds_all(frame, monkeypatch):
    monkeypatch.setattr(jaccard, "PIVOT_ROUNDS", 0)
    rows = corpus(4)
    assert result(frame, rows, JaccardRule(4, 85)) == brute(rows, JaccardRule(4, 85))


def test_empty_table_and_long_text(frame):
    assert result(frame, [], JaccardRule()) == []
    long = " ".join(f"x{i}" for i in range(60000))
    rows = [(1, long), (2, long + " tail"), (3, "short one")]
    assert [r[2] for r in result(frame, rows, JaccardRule())] == [1, 1, 3]
