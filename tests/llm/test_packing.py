import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from capstrata.llm import packing


def brute_best_fit(lengths, capacity):
    """Piece by piece: the tightest open bin, else a new one."""
    rest = []
    for n in sorted(lengths, reverse=True):
        fits = [(c, i) for i, c in enumerate(rest) if c >= n]
        if fits:
            rest[min(fits)[1]] -= n
        else:
            rest.append(capacity - n)
    return sorted(rest)


def check_layout(rows, capacity):
    bins = defaultdict(list)
    for length, seq, off in rows:
        bins[seq].append((off, length))
    for parts in bins.values():
        at = 0
        for off, length in sorted(parts):
            assert off == at
            at += length
        assert at <= capacity
    return bins


@pytest.mark.parametrize("seed", range(30))
def test_plan_equals_piece_by_piece(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 10, 64, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    rest = defaultdict(lambda: capacity)
    for length, rank, first, per, offset in packing.best_fit_plan(counts, capacity):
        later = [r for n, r, *_ in packing.best_fit_plan(counts, capacity) if n == length and r > rank]
        for r in range(rank, min(later, default=counts[length])):
            b = first + (r - rank) // per
            assert capacity - rest[b] == offset + (r - rank) % per * length
            rest[b] -= length
            assert rest[b] >= 0
    assert sorted(rest.values()) == brute_best_fit(lengths, capacity)


def test_capacity_tree():
    rng = random.Random(1)
    tree, is_open = packing.CapacityTree(37), set()
    for _ in range(2000):
        c = rng.randint(0, 37)
        on = rng.random() < 0.3
        tree.set(c, on)
        (is_open.add if on else is_open.discard)(c)
        need = rng.randint(0, 37)
        assert tree.tightest(need) == min((x for x in is_open if x >= need), default=None)


def test_encoder_equals_tokenizer_file():
    both = packing.Encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))
    full = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["", " ", "a  b\n\n c", "It's 12,5% <|endoftext|> end", "日本語 テスト", "x y z\u0085w", "é ﬁ 𝒳 🙂", " 1 000 €"]
    texts += [f"ab {chr(c)}{chr(c)} 1{chr(c)}\n{chr(c)} z" for c in range(0x500)] + [f"ab {chr(c)}{chr(c)} 1{chr(c)}\n z" for c in range(0x2000, 0x20C0)]
    for t in texts:
        assert both(t) == full.encode(t, add_special_tokens=False).ids, repr(t)


def test_tokenize_and_pack(spark, frame):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "x", "ça", "日本"]) for _ in range(rng.choice([0, 1, 5, 40, 200])))) for i in range(60)]
    docs += [(7, docs[7][1]), (100, None), (101, ""), (102, "word " * 3000), (None, "no id")]
    df = frame([(*d, "own", 5) for d in docs], "doc_id long, text string, offset string, part int")
    cut = packing.tokenize_pieces(df, "doc_id", "text", P.path("byte_bpe_50k.json"), 64, 2, P.path("byte_bpe_50k.tiktoken"))
    placed = packing.pack_best_fit(cut, "length", 64, ["doc_id", "piece", "ids_crc32"]).cache()
    rows = placed.collect()
    full = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for k, t in docs:
        ids = [*full.encode(t or "", add_special_tokens=False).ids, 2]
        assert sum(n for _, n in packing.pieces(len(ids), 64)) == len(ids)
        for i, (s, n) in enumerate(packing.pieces(len(ids), 64)):
            part = ids[s:s + n]
            want.append((k, i, s, n, zlib.crc32(np.array(part, "<u4").tobytes()), part))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, list(r.ids)) for r in rows), key=key) == sorted(want, key=key)
    bins = check_layout([(r.length, r.sequence_id, r.offset) for r in rows], 64)
    assert len(bins) == len(brute_best_fit([w[3] for w in want], 64))
    made = {r.sequence_id: list(r.tokens) for r in packing.assemble(placed).collect()}
    for r in rows:
        assert made[r.sequence_id][r.offset:r.offset + r.length] == list(r.ids)


def test_empty_table_and_null_length(spark, frame):
    none = frame([], "doc_id long, piece int, length long, ids_crc32 long")
    assert packing.pack_best_fit(none, "length", 8, ["doc_id"]).collect() == []
    with pytest.raises(ValueError):
        packing.pack_best_fit(frame([(1, None)], "doc_id long, length long"), "length", 8, ["doc_id"])
    with pytest.raises(ValueError):
        packing.best_fit_plan({9: 1}, 8)
