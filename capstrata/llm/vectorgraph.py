"""Approximate nearest neighbours: robust-pruned directed graphs per shard, searched by beams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capstrata.session import stage


@dataclass(frozen=True)
class GraphRule:
    """`degree` edges a vector; beams of `build_beam` and `beam`; `alpha` relaxes the pruning; shards of about `shard` vectors.

    `block` queries visit a shard at once. `shard` and `block` bound a task's memory and leave the rows searched as they are.
    """

    k: int = 10
    degree: int = 32
    build_beam: int = 48
    beam: int = 128
    alpha: float = 1.2
    shard: int = 4096
    block: int = 1024


#: Vectors inserted at once, and beam entries expanded at once.
INSERTED, EXPANDED = 512, 4


def squared(x: np.ndarray, norms: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of x[ids[i]] and q[i], less |q[i]|^2."""
    return norms[ids] - 2 * np.einsum("ij,ij->i", x[ids], q)


def beam_search(x: np.ndarray, norms: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> np.ndarray:
    """The `beam` nearest vectors that a greedy search from `entry` meets for each query, nearest first (-1: none)."""
    n, q = len(x), len(queries)
    ids = np.full((q, beam), -1, np.int64)
    far = np.full((q, beam), np.inf, x.dtype)
    open_ = np.zeros((q, beam), bool)
    seen = np.zeros(q * n, bool)
    ids[:, 0], far[:, 0], open_[:, 0] = entry, squared(x, norms, np.full(q, entry), queries), True
    seen[np.arange(q) * n + entry] = True
    while open_.any():
        nth = np.cumsum(open_, axis=1)
        row, at = np.nonzero(open_ & (nth <= EXPANDED))
        open_[row, at] = False
        near = edges[ids[row, at]]
        flat = np.unique((row[:, None] * n + near)[near >= 0])
        flat = flat[~seen[flat]]
        if not len(flat):
            continue
        seen[flat] = True
        row, new = flat // n, flat % n
        count = np.bincount(row, minlength=q)
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        width = int(count.max())
        more_ids, more_far = np.full((q, width), -1, np.int64), np.full((q, width), np.inf, x.dtype)
        more_ids[row, place], more_far[row, place] = new, squared(x, norms, new, queries[row])
        all_far = np.concatenate([far, more_far], axis=1)
        order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        far = np.take_along_axis(all_far, order, axis=1)
        ids = np.take_along_axis(np.concatenate([ids, more_ids], axis=1), order, axis=1)
        open_ = np.take_along_axis(np.concatenate([open_, more_ids >= 0], axis=1), order, axis=1)
    return ids


def robust_prune(x: np.ndarray, norms: np.ndarray, nodes: np.ndarray, proposed: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Up to `degree` diverse neighbours of each node out of its row of proposals (-1: none).

    The nearest proposal left becomes a neighbour and drops every proposal that is `alpha` times nearer to it than to the node.
    """
    valid = (proposed >= 0) & (proposed != nodes[:, None])
    p = np.where(valid, proposed, 0)
    v = x[p]
    own = norms[nodes][:, None] + norms[p] - 2 * np.einsum("ijk,ik->ij", v, x[nodes])
    order = np.argsort(np.where(valid, own, np.inf), axis=1, kind="stable")
    p, own, valid = (np.take_along_axis(a, order, axis=1) for a in (p, own, valid))
    v = np.take_along_axis(v, order[:, :, None], axis=1)
    between = norms[p][:, :, None] + norms[p][:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    out, rows = np.full((len(nodes), degree), -1, np.int64), np.arange(len(nodes))
    for at in range(degree):
        first = valid.argmax(axis=1)
        live = valid[rows, first]
        if not live.any():
            break
        out[live, at] = p[rows, first][live]
        valid &= (alpha * alpha * between[rows, first] > own) & (p != p[rows, first][:, None])
    return out


def reached(edges: np.ndarray, entry: int) -> np.ndarray:
    seen, front = np.zeros(len(edges), bool), np.array([entry])
    seen[entry] = True
    while len(front):
        front = np.unique(edges[front])
        front = front[(front >= 0) & ~seen[np.maximum(front, 0)]]
        seen[front] = True
    return seen


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors moved to their centre and scaled, in single precision: distances keep their order up to rounding."""
    x = x.astype(np.float64) / max(np.abs(x).max(initial=0), np.finfo(np.float64).tiny)
    x = x - x.mean(axis=0)
    return (x / max(np.abs(x).max(initial=0), 1e-300)).astype(np.float32)


def build(x: np.ndarray, rule: GraphRule, seed: int) -> tuple[np.ndarray, int]:
    """(edges, entry) over the rows of x: -1 fills short rows; every row can be reached from the entry.

    Starts from random edges; in two rounds, the second with `alpha`, greedy searches propose neighbours for batches of
    vectors, pruning keeps diverse ones, and edges are returned, pruned again where a vector has too many.
    """
    n, rng = len(x), np.random.default_rng(seed)
    norms = np.einsum("ij,ij->i", x, x)
    entry = int(np.argmin(norms))  # the centre is 0
    degree = min(rule.degree, n - 1)
    if degree < 1:
        return np.full((n, 1), -1, np.int64), entry
    edges = rng.integers(0, n, (n, rule.degree))
    edges[edges == np.arange(n)[:, None]] = -1
    for alpha in (1.0, rule.alpha):
        order = rng.permutation(n)
        for start in range(0, n, INSERTED):
            nodes = order[start:start + INSERTED]
            met = beam_search(x, norms, edges, entry, x[nodes], rule.build_beam)
            edges[nodes] = robust_prune(x, norms, nodes, distinct(np.concatenate([met, edges[nodes]], axis=1)), alpha, rule.degree)
            source, to = np.repeat(nodes, rule.degree), edges[nodes].ravel()
            source, to = source[to >= 0], to[to >= 0]
            order_to = np.argsort(to, kind="stable")
            source, to = source[order_to], to[order_to]
            target, first, count = np.unique(to, return_index=True, return_counts=True)
            for wide in np.unique(1 << np.ceil(np.log2(count)).astype(np.int64)):  # rows of like length together
                some = np.nonzero((count <= wide) & (count > wide // 2))[0]
                back = np.full((len(some), int(wide)), -1, np.int64)
                place = np.arange(count[some].sum()) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
                back[np.repeat(np.arange(len(some)), count[some]), place] = source[np.repeat(first[some], count[some]) + place]
                both = distinct(np.concatenate([edges[target[some]], back], axis=1))
                full = (both >= 0).sum(axis=1) > rule.degree
                both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)
                edges[target[some][~full]] = both[~full][:, :rule.degree]
                chunk = max(1, (1 << 22) // both.shape[1] ** 2)
                for at in range(0, int(full.sum()), chunk):
                    rows = np.nonzero(full)[0][at:at + chunk]
                    edges[target[some][rows]] = robust_prune(x, norms, target[some][rows], both[rows], alpha, rule.degree)
    lost = np.nonzero(~reached(edges, entry))[0]
    while len(lost):
        near = beam_search(x, norms, edges, entry, x[lost], 1)[:, 0]  # all of them can be reached
        _, first = np.unique(near, return_index=True)
        extra = np.full((n, 1), -1, np.int64)
        extra[near[first], 0] = lost[first]
        edges = np.concatenate([edges, extra], axis=1)
        lost = np.nonzero(~reached(edges, entry))[0]
    return edges, entry


def distinct(ids: np.ndarray) -> np.ndarray:
    """Each row sorted, with repeats replaced by -1."""
    ids = np.sort(ids, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    return ids


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, k1, k2) of the rows that take part; k1, k2 name the vector's value."""
    raw = F.col(f"`{vector}`")
    good = raw.isNotNull() & (F.size(raw) > 0) & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(raw, lambda x: x != 0)
    plain = F.transform(raw, lambda x: F.when(x == 0, F.lit(0.0).cast(df.schema[vector].dataType.elementType)).otherwise(x))
    rows = df.select(F.col(f"`{key}`").alias("id"), F.when(F.coalesce(good, F.lit(False)), plain).alias("v")).where("id is not null and v is not null")
    return rows.select("id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit("second"), "v").alias("k2"))


def build_graphs(df: DataFrame, key: str, vector: str, rule: GraphRule = GraphRule()) -> DataFrame:
    """The index: one row per distinct vector with (dim, shard, node, ids, v, edges, entry), staged.

    Vectors are dealt to shards by a hash of their value, so shards are equal and copies of one vector are one node.
    `ids` holds the node's k + 1 smallest keys: no search for k rows beside the query's own can need more of them.
    Vectors of each length have shards of their own. `edges` are node numbers within the shard.
    """
    rows = usable(df, key, vector)
    rank = F.dense_rank().over(Window.partitionBy("k1", "k2").orderBy("id"))
    few = rows.withColumn("rank", rank).where(F.col("rank") <= rule.k + 1)
    kind = df.schema[key].dataType.simpleString()
    vectors = stage(few.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.first("v").alias("v")).withColumn("dim", F.size("v")))
    shards = vectors.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / rule.shard).cast("int").alias("shards"))
    tasks = shards.agg(F.sum("shards")).first()[0] or 1  # a shard costs seconds: few bytes must not bring many into one task
    placed = vectors.join(shards, "dim").select("dim", F.pmod(F.xxhash64(F.lit("shard"), "k1", "k2"), "shards").cast("int").alias("shard"), "k1", "ids", "v")

    def work(t: pa.Table) -> pa.Table:
        t = t.sort_by([("k1", "ascending")])
        edges, entry = build(scaled(matrix(t["v"])), rule, t["shard"][0].as_py())
        node = np.arange(t.num_rows)
        return pa.table({
            "dim": t["dim"], "shard": t["shard"], "node": pa.array(node.astype(np.int32)), "ids": t["ids"], "v": t["v"],
            "edges": pa.array([e[e >= 0].astype(np.int32) for e in edges], pa.list_(pa.int32())), "entry": pa.array(node == entry),
        })

    element = df.schema[vector].dataType.elementType.simpleString()
    return stage(placed.repartition(tasks, "dim", "shard").groupBy("dim", "shard").applyInArrow(work, f"dim int, shard int, node int, ids array<{kind}>, v array<{element}>, edges array<int>, entry boolean"))


def nearest(graphs: DataFrame, queries: DataFrame, key: str, vector: str, rule: GraphRule = GraphRule()) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows found, other than rows of its own key, nearest first.

    Every query visits every shard of its vector's length by a beam search; the beam is then ranked by Euclidean distances
    of the original vectors in double precision (ties: the smaller key), and the shards' lists are merged in Spark.
    """
    kind = queries.schema[key].dataType.simpleString()
    asked = stage(usable(queries, key, vector).select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.size("v").alias("dim")).distinct())
    blocks = -(-asked.count() // rule.block) or 1
    spots = graphs.select("dim", "shard").distinct()
    visits = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).join(spots, "dim")
    visits = visits.select(F.col("dim").alias("d"), F.col("shard").alias("s"), F.col("block").alias("b"), "query_id", "q")
    held = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def work(graph: pa.Table, some: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if graph.num_rows and some.num_rows:
            graph = graph.sort_by([("node", "ascending")])
            x, q = matrix(graph["v"]), matrix(some["q"])
            lists = graph["edges"].to_pylist()
            edges = np.full((len(lists), max(1, max(map(len, lists)))), -1, np.int64)
            for e, to in zip(edges, lists):
                e[:len(to)] = to
            both = scaled(np.concatenate([x, q]))
            near, norms = both[:len(x)], np.einsum("ij,ij->i", both[:len(x)], both[:len(x)])
            entry = int(np.argmax(graph["entry"].to_numpy(zero_copy_only=False)))
            ids, keys = graph["ids"].to_pylist(), some["query_id"].to_pylist()
            for start in range(0, len(q), 256):
                met = beam_search(near, norms, edges, entry, both[len(x) + start:len(x) + start + 256], rule.beam)
                for own, v, m in zip(keys[start:start + 256], q[start:start + 256], met):
                    m = m[m >= 0]
                    gap = x[m] - v
                    size = np.abs(gap).max(axis=1)
                    with np.errstate(over="ignore", under="ignore"):
                        score = np.sqrt((gap * gap).sum(axis=1))
                    odd = ~np.isfinite(score) | ((score < 1e-150) & (size > 0))
                    if odd.any():  # squares that leave the range of doubles
                        score[odd] = size[odd] * np.sqrt(((gap[odd] / size[odd][:, None]) ** 2).sum(axis=1))
                    rows: list[tuple] = []
                    last = None
                    for i in np.argsort(score, kind="stable").tolist():
                        if len(rows) >= rule.k and score[i] > last:
                            break
                        last = score[i]
                        rows += [(last, key) for key in ids[m[i]] if key != own]
                    for s, key in sorted(rows)[:rule.k]:
                        for c, value in zip(found, (own, key, float(s))):
                            c.append(value)
        return pa.table({"query_id": pa.array(found[0], some.schema.field("query_id").type), "vec_id": pa.array(found[1], some.schema.field("query_id").type), "score": pa.array(found[2], pa.float64())})

    lists = held.groupBy("dim", "shard", "block").cogroup(visits.groupBy("d", "s", "b")).applyInArrow(work, f"query_id {kind}, vec_id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return lists.withColumn("rank", rank).where(F.col("rank") <= rule.k).select("query_id", "rank", "vec_id", "score")
