import random
import re

import pytest

from capstrata.llm import linededup
from capstrata.llm.linededup import LineRule


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, rule):
    """(id, text) of unique rows to the dropped (id, text, pos)."""
    lines = []
    for k, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        for pos, line in enumerate((t or "").split("\n")):
            w = [x for x in re.split(r"[ \t\x0B\f\r]+", line.lower()) if x]
            if len(w) >= rule.min_words:
                lines.append((k, t, pos, w))
    out, first = set(), {}
    for i, (k, t, pos, w) in enumerate(lines):
        first.setdefault(tuple(w), i)
    for i, (k, t, pos, w) in enumerate(lines):
        at = first[tuple(w)]
        near = len(w) >= rule.near_words and any(len(v[3]) >= rule.near_words and abs(len(v[3]) - len(w)) < 2 and distance(v[3], w) == 1 for v in lines[:at])
        if at < i or near:
            out.add((k, t, pos))
    return out


def corpus(seed, rule):
    rng = random.Random(seed)
    vocab = ["a", "b", "c", "D", "é", "x1"]
    lines = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, rule.near_words + 6))) for _ in range(60)]
    for _ in range(150):
        w = rng.choice(lines).split(" ")
        for _ in range(rng.choice([0, 1, 1, 1, 2])):
            i = rng.randrange(len(w) + 1)
            w[i:i + rng.randint(0, 1)] = [rng.choice(vocab) for _ in range(rng.randint(0, 1))]
        lines.append(rng.choice([" ", "  ", "\t"]).join(w))
    rng.shuffle(lines)
    rows, at = [], 0
    while at < len(lines):
        n = rng.randint(1, 6)
        rows.append((1000 - at, "\n".join(lines[at:at + n])))
        at += n
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(frame, seed):
    rule = LineRule(2, [4, 3, 10, 6][seed])
    rows = corpus(seed, rule) + [(2000, None), (2001, ""), (2002, "\n\n"), (None, "a b c d e f g\nno id here at all, nothing like it")]
    rows += [rows[3], rows[3]]
    df = frame([(*r, 0, "x") for r in rows], "doc_id long, text string, pos int, version string")
    got = linededup.repeated_lines(df, "doc_id", "text", rule).collect()
    text = {linededup_version: t for (_, t), linededup_version in zip(rows, [r[0] for r in linededup.versions(df, "doc_id", "text").select("version").collect()])}
    assert {(r.id, text[r.version], r.pos) for r in got} == brute(rows, rule)


def test_documents_keep_the_rest(frame):
    rows = [(1, "one two three\n\nfour five six"), (2, "One  two three\nseven eight nine"), (3, "four five six"), (4, None), (5, " \n"), (6, "ab"), (2, "One  two three\nseven eight nine")]
    df = frame([(*r, 3) for r in rows], "doc_id long, text string, pos int")
    got = linededup.drop_repeated(df, "doc_id", "text")
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect())) == [(1, rows[0][1]), (2, "seven eight nine"), (2, "seven eight nine"), (4, None), (5, " \n"), (6, "ab")]


def test_replaced_word_among_many(frame):
    rows = [(i, f"item {i} is sold in our own shop for five euro each today") for i in range(200)]
    got = linededup.repeated_lines(frame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert {r.id for r in got} == set(range(1, 200)) and {r.kept.id for r in got} == {0}


def test_lines_are_cut_into_words_once(frame):
    docs = linededup.versions(frame([(1, "one two three\nfour five"), (2, None), (3, "")], "doc_id long, text string"), "doc_id", "text")
    lines = linededup.line_rows(docs, LineRule())
    assert [(r.id, r.pos, r.words) for r in lines.collect()] == [(1, 0, ["one", "two", "three"])]
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("array_remove(") == 1


def test_empty_table(frame):
    assert linededup.drop_repeated(frame([], "doc_id long, text string"), "doc_id", "text").collect() == []


def test_variants_carry_numbers_instead_of_words(frame):
    words = [f"w{i}" for i in range(12)]
    other = words[:4] + ["new"] + words[5:]
    lines = frame([(1, 1, 0, words), (2, 2, 1, words[:6] + words[7:]), (3, 3, 2, other)], "h1 long, h2 long, place int, words array<string>")
    found = linededup.variants(lines)
    generates = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in x]
    assert generates and not any("words#" in x for x in generates)
    of = {}
    for r in found.collect():
        of.setdefault(r.h1, {})[r.at] = r.variant
    assert [len(set(of[h].values())) for h in (1, 2, 3)] == [13, 12, 13]
    assert of[1][7] == of[2][0] and of[1][5] == of[3][5] and of[1][0] != of[3][0]
