import numpy as np
import pytest

from capstrata.llm import neardup
from capstrata.llm.neardup import RangeRule


def brute(rows, cosine):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in ok}
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in ok:
        for y in ok:
            if x < y and len(unit[x]) == len(unit[y]) and unit[x] @ unit[y] >= cosine:
                n[x] += 1
                n[y] += 1
                root[find(y)] = find(x)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return sorted(((k, n[i], low.get(find(i)), k == low.get(find(i))) for i, (k, _) in enumerate(rows)), key=repr)


def corpus(seed, dim):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dim) for _ in range(120)]
    for c in range(8):
        centre = rng.normal(size=dim)
        rows += [centre + rng.normal(size=dim) * 0.12 * np.linalg.norm(centre) / np.sqrt(dim) * rng.uniform(0.5, 3) for _ in range(25)]
    rows += [rows[0] * 3, rows[5], rows[5], rows[5]]
    vectors = [[float(np.float32(x)) for x in v] for v in rows]
    out = [(1000 - i, v) for i, v in enumerate(vectors)]
    odd = [(1, None), (2, []), (3, [0.0] * dim), (4, [float("nan")] + [1.0] * (dim - 1)), (5, [float("inf")] + [1.0] * (dim - 1)), (6, [None] + [1.0] * (dim - 1)), (7, [1.0]), (8, [2.0]), (9, [-1.0]), (None, vectors[7]), (None, vectors[9])]
    return out + odd + [out[4], out[4]]


@pytest.mark.parametrize("seed,dim,rule", [(0, 6, RangeRule(0.95, 8, 16)), (1, 3, RangeRule(0.9, 20, 7)), (2, 16, RangeRule(0.95, 32, 4096)), (3, 2, RangeRule(0.5, 5, 10)), (4, 5, RangeRule(1.0 - 1e-9, 4, 50))])
def test_equals_brute_force(frame, seed, dim, rule):
    rows = corpus(seed, dim)
    df = frame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, node int, n string")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in neardup.near_vectors(df, "vec_id", "embedding", rule).collect()]
    want = [(k, n, c, (k == c)) for k, n, c, _ in brute(rows, rule.cosine)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty(frame):
    assert neardup.near_vectors(frame([], "vec_id long, embedding array<double>"), "vec_id", "embedding").collect() == []
    assert len(neardup.near_vectors(frame([(1, None)], "vec_id long, embedding array<double>"), "vec_id", "embedding").collect()) == 1
