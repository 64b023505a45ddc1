import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from capstrata.llm import align
from capstrata.llm.align import AlignRule
from capstrata.llm.queries import LLM_QUERIES

A, B, RANKS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken")
DIR = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  ", "a", "a ", " a", "a  b", "a\n b", "a \nb", "a\n \nb  ", "tab\t and nbsp 　x", "▁x", "<|endoftext|> <s>hi</s> <0x41>", "naïve 你好 🙂👩‍👩‍👧 ", "é ä",
       "x" * 3000, "=" * 500 + " " * 77 + "-" * 301, "the the the the", "the the the the", "it's we'll I'd", "\x00\x1f \x1f z", "ab " * 2000]


def brute(rows):
    """The contract word for word, one token and one link at a time."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok, b_tok = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    plain = {c: i for i, c in enumerate(align.byte_characters())}
    a_entry = {i: e for e, i in a_tok.get_vocab().items()}
    docs, held, out = [], Counter(), []
    for key, text in rows:
        groups = []
        if text:
            a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
            x = [bytes(plain[c] for c in a_entry[i]) for i in a]
            y = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(x) == b"".join(y) == (" " + text).encode():
                ends_a, ends_b = np.cumsum([len(t) for t in x]).tolist(), np.cumsum([len(t) for t in y]).tolist()
                last = 0
                for cut in sorted(set(ends_a) & set(ends_b)):
                    groups.append(([i for i, e in zip(a, ends_a) if last < e <= cut], [i for i, e in zip(b, ends_b) if last < e <= cut]))
                    last = cut
        links = [(i, j) for u, v in groups for i in u for j in v]
        docs.append((key, groups, links))
        held.update(set(links))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    for key, groups, links in docs:
        said = ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in groups)
        out.append((key, sum(len(u) for u, _ in groups), sum(len(v) for _, v in groups), len(groups), len(links),
                    sum(held[k] == best[k[0]] for k in links), sum(held[k] for k in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr), held


def result(rows):
    return sorted(((r[0], r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.digest) for r in rows), key=repr)


@pytest.mark.parametrize("rule", [AlignRule(), AlignRule(piece=3, batch=50, block=4000), AlignRule(piece=64, batch=2000, block=1, pairs=10)])
def test_odd_texts_equal_brute_force(frame, rule):
    rows = [(i if i % 7 else None, t) for i, t in enumerate([*ODD, *ODD[5:9]])]
    df = frame([(k, t, "x", 1) for k, t in rows], "doc long, text string, `key` string, pairs int")
    found = align.align_tokens(df, "doc", "text", A, B, RANKS if rule.piece != 64 else None, rule)
    want, held = brute(rows)
    assert result(found.scores().collect()) == want
    assert {(r.a_id, r.b_id): r.n_docs for r in found.pairs.collect()} == held
    for r in found.groups().where("doc = 20 and position < 2").orderBy("position").collect():
        assert r.a_ids and r.b_ids


@pytest.mark.skipif(not Path(DIR).exists(), reason="no driver tables")
def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = LLM_QUERIES["op11_token_alignment"](spark, DIR)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert result(got.withColumnRenamed("groups_sha256", "digest").collect()) == brute(docs)[0]


def test_empty_table_and_texts_without_tokens(frame):
    assert align.align_tokens(frame([], "doc long, text string"), "doc", "text", A, B).scores().collect() == []
    none = align.align_tokens(frame([(1, None), (2, "▁")], "doc long, text string"), "doc", "text", A, B).scores()
    assert result(none.collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_groups_have_one_short_key():
    seen, ids = align.Dictionary(), lambda *x: np.array(x, np.int32)
    groups = [(ids(1, 2), ids(3)), (ids(1), ids(2, 3)), (ids(1, 2, 3), ids(4)), (ids(2, 2), ids(3, 3)), (ids(40000), ids(31999))]
    assert [seen.add(a, b) for a, b in groups] == [seen.add(a, b) for a, b in groups] == list(range(5))
    assert [len(k) for k in seen.index] == [16, 16, 20, 20, 12]
    assert seen.texts == ["1,2|3", "1|2,3", "1,2,3|4", "2,2|3,3", "40000|31999"]
    pairs = list(seen.pair_index)
    assert (1 << 32 | 3) in pairs and (40000 << 32 | 31999) in pairs and seen.group_weights[-2:] == [4, 1]


ends = st.lists(st.integers(1, 300), max_size=60, unique=True).map(sorted)


@settings(max_examples=200, deadline=None)
@given(ends, ends, st.integers(1, 20))
def test_pieces_are_equal_and_stitch_to_the_common_ends(a, b, size):
    a, b = np.array([*a, 301]), np.array([*b, 301])
    i, j = align.merge_path(a, b, size)
    assert (np.diff(i + j)[:-1] == size).all() and i[-1] == len(a) and j[-1] == len(b)
    order = sorted([(v, 0) for v in a.tolist()] + [(v, 1) for v in b.tolist()])
    assert all(sum(1 for _, s in order[:i[k] + j[k]] if s == 0) == i[k] for k in range(len(i)))
    x, y = align.groups_of(a, b, size)
    assert a[x - 1].tolist() == b[y - 1].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list("ab. \n\t\xa0\u3000\x1fé▁'s1你")), min_size=1, max_size=40))
def test_faster_ways_encode_like_whole_texts(text):
    pair = both()
    assert pair.by_unit
    assert (list(pair.encode_a(" " + text)), list(pair.encode_b(" " + text))) == (pair.full_a(" " + text), pair.full_b(" " + text))


_made = []


def both():
    if not _made:
        _made.append(align.TokenizerPair(A, B, RANKS))
    return _made[0]


@pytest.mark.parametrize("size", [1, 3, 4, 1000])
def test_sums_of_lists_gathered_in_chunks(monkeypatch, size):
    import pyarrow as pa

    monkeypatch.setattr(align, "GATHERED", size)
    lists = [[], [], [0, 2, 2], [], [1], [2, 1, 0, 0, 0, 1], [], []]
    values = np.array([[1, 10, 100], [-7, 1 << 60, 3]])
    want = [[sum(int(v[i]) for i in x) for x in lists] for v in values]
    assert align.list_sums(values, pa.array(lists, pa.list_(pa.int32()))).tolist() == want
    assert align.list_sums(np.zeros((2, 0), np.int64), pa.array([[], []], pa.list_(pa.int32()))).tolist() == [[0, 0], [0, 0]]
    assert align.list_sums(values, pa.array([], pa.list_(pa.int32()))).shape == (2, 0)
    assert align.list_sums(values, pa.array(lists, pa.list_(pa.int32()))[4:6]).tolist() == [w[4:6] for w in want]


def test_scores_of_a_block_take_little_memory_beside_it():
    import tracemalloc

    import pyarrow as pa

    n = 4_000_000  # group occurrences: one value of each would take 64 MB
    lists = pa.ListArray.from_arrays(np.arange(0, n + 1, n // 1000, dtype=np.int32), np.arange(n, dtype=np.int32) % 5)
    tracemalloc.start()
    try:
        got = align.list_sums(np.arange(10).reshape(2, 5), lists)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.tolist() == [[8000] * 1000, [28000] * 1000]
    assert peak < 8 << 20
