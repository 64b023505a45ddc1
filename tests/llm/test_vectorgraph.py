from pathlib import Path

import numpy as np
import pytest

from capstrata.llm import vectorgraph
from capstrata.llm.queries import LLM_QUERIES
from capstrata.llm.vectorgraph import GraphRule

DIR = "/root/testdata/sf0.1"


def good(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, k, asks):
    """{query: all other keys by (distance, key)}, and the distances."""
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and good(v)]
    out = {}
    for i, q in ok:
        if asks(i):
            near = {(j, float(np.sqrt(((v - q) ** 2).sum()))) for j, v in ok if j != i and len(v) == len(q)}
            out[i] = sorted((d, j) for j, d in near)[:k]
    return out


def result(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    out = {}
    for r in sorted(df.collect()):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.score, r.vec_id))
    return out


def recall(got, want):
    """Share of the true distances reached; what is found must be ranked and measured rightly."""
    hits = total = 0
    for q, near in want.items():
        found = got.get(q, [])
        assert found == sorted(found) and len({j for _, j in found}) == len(found) == len(near)
        hits += len({j for _, j in found} & {j for _, j in near})
        total += len(near)
    return hits / max(total, 1)


@pytest.mark.parametrize("rule", [GraphRule(shard=150, degree=12, build_beam=24, beam=40), GraphRule(k=3, shard=10_000, degree=12, build_beam=24, beam=48, block=3)])
def test_graph_search_finds_the_nearest(frame, rule):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12)) * 4
    vectors = [(centres[i % 6] + rng.normal(size=12)).tolist() for i in range(600)]
    vectors += [vectors[0]] * 40 + [[x * 2 for x in vectors[3]]] * 3  # a group larger than k, and a small one
    rows = [(10 * i, v) for i, v in enumerate(vectors)]
    rows += [(1, None), (2, []), (3, [0.0] * 12), (4, [float("nan")] + [1.0] * 11), (5, [None] + [1.0] * 11), (6, [float("inf")] * 12), (None, vectors[5])]
    rows += [(70_000, [1.0, 2.0]), (70_001, [1.0, 2.5]), (70_050, [7.0])] + rows[7:9]  # other lengths, repeated rows
    df = frame([(k, v, 1, "s") for k, v in rows], "vec_id long, embedding array<double>, node int, shard string")
    graphs = vectorgraph.build_graphs(df, "vec_id", "embedding", rule)
    got = result(vectorgraph.nearest(graphs, df.where("vec_id % 50 = 0"), "vec_id", "embedding", rule))
    want = brute(rows, rule.k, lambda i: i % 50 == 0)
    assert recall(got, want) >= 0.97
    assert got[0] == want[0] and {d for d, _ in got[0]} == {0.0}  # the copies with the smallest keys
    assert got[70_000] == [(0.5, 70_001)] and 70_050 not in got
    for q, found in got.items():
        exact = {j: d for d, j in brute(rows, 10**6, lambda i: i == q)[q]}  # noqa: B023
        assert all(exact[j] == pytest.approx(d, rel=1e-12, abs=0) for d, j in found)


def test_every_vector_is_reached_and_degrees_hold():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(300, 8)), rng.normal(size=(20, 8)) * 1e-4 + 50, [[1e3] * 8]])
    edges, entry = vectorgraph.build(vectorgraph.scaled(x), GraphRule(degree=6, build_beam=12), 1)
    assert vectorgraph.reached(edges, entry).all()
    assert ((edges >= 0).sum(axis=1) <= 6 + edges.shape[1] - 6).all() and (edges < len(x)).all() and not (edges == np.arange(len(x))[:, None]).any()


def test_pruning_keeps_diverse_edges():
    x = vectorgraph.scaled(np.array([[0.0, 0.0], [1.0, 0.0], [1.1, 0.0], [-2.0, 0.0], [0.0, 3.0]]))
    norms = np.einsum("ij,ij->i", x, x)
    kept = vectorgraph.robust_prune(x, norms, np.array([0]), np.array([[1, 2, 3, 4, -1, 0]]), 1.2, 4)
    assert kept.tolist() == [[1, 3, 4, -1]]


def test_few_rows_and_extreme_values(frame):
    rule = GraphRule()
    for rows in ([], [(0, [1.0])], [(0, [1.0]), (1, [1e-200]), (2, [-1e200])], [(0, [1e308, 1e308]), (100, [-1e308, 1e308])]):
        df = frame(rows, "vec_id long, embedding array<double>")
        got = result(vectorgraph.nearest(vectorgraph.build_graphs(df, "vec_id", "embedding", rule), df.where("vec_id % 100 = 0"), "vec_id", "embedding", rule))
        assert {q: [j for _, j in f] for q, f in got.items()} == {q: [j for _, j in f] for q, f in brute(rows, 10, lambda i: i % 100 == 0).items() if f}


@pytest.mark.skipif(not Path(DIR).exists(), reason="no driver tables")
def test_recall_of_the_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
    got = result(LLM_QUERIES["op13_vector_graph_search"](spark, DIR))
    assert recall(got, brute(rows, 10, lambda i: i % 100 == 0)) >= 0.98
