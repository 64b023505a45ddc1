"""Embedding near-dedup by an exact metric range join: pivots, boundary replication, independent cells."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capstrata.operators.graph import connected_components
from capstrata.session import stage, unstage


@dataclass(frozen=True)
class RangeRule:
    """Vectors are linked when their cosine is at least `cosine`; `pivots` cells, joined in blocks of about `block` vectors."""

    cosine: float = 0.95
    pivots: int = 32
    block: int = 2048

    @property
    def radius(self) -> float:
        """The same bound as a Euclidean distance between unit vectors."""
        return float(np.sqrt(2 - 2 * self.cosine))


#: Added to the radius where vectors are only kept apart, never where links are decided.
SLACK = 1e-6


def units(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision, one row each; all vectors have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(np.float64).tiny)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def assign_cells(nodes: DataFrame, pivots: np.ndarray, rule: RangeRule) -> DataFrame:
    """(node, mult, v, dim, cell, home): every vector in its nearest pivot's cell and in later cells it may reach.

    With home distance h, a partner within r in cell j implies d(x, p_j) <= h + 2 r, and x lies at most r beyond the
    plane between both pivots: (d(x, p_j)^2 - h^2) / (2 d(p_h, p_j)) <= r. A pair with different homes meets in the
    cell of the higher number alone, so every pair is compared once. Vectors of another length than the pivots' have
    a cell of their own.
    """
    r, kind = rule.radius + SLACK, nodes.schema["v"].dataType.simpleString()
    between = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T)) if len(pivots) else np.zeros((0, 0))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                for at in range(0, part.num_rows, 4096):
                    some = part.slice(at, 4096)
                    if not len(pivots) or dim != pivots.shape[1]:
                        rows, cell, home = np.arange(some.num_rows), np.full(some.num_rows, -1), np.ones(some.num_rows, bool)
                    else:
                        d = np.sqrt(np.maximum(0, 2 - 2 * units(some.column(2)) @ pivots.T))
                        h = d.argmin(axis=1)
                        own = d[np.arange(len(d)), h][:, None]
                        reach = (d <= own + 2 * r) & (d * d - own * own <= 2 * between[h] * r + SLACK) & (np.arange(len(pivots)) > h[:, None])
                        reach[np.arange(len(d)), h] = True
                        rows, cell = np.nonzero(reach)
                        home = cell == h[rows]
                    taken = some.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell.astype(np.int32)), pa.array(home)], names=["node", "mult", "v", "dim", "cell", "home"])

    return nodes.select("node", "mult", "v", "dim").mapInArrow(work, f"node long, mult long, v {kind}, dim int, cell int, home boolean")


def forest(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join two trees so far; root is updated."""
    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            yield x, y


def join_blocks(rule: RangeRule):
    """Compare the two blocks of a unit: link counts per vector, and links enough to connect what is connected."""
    def work(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        side = t["side"].to_numpy()
        node, mult = t["node"].to_numpy(), t["mult"].to_numpy()
        x = units(t["v"].combine_chunks() if isinstance(t["v"], pa.ChunkedArray) else t["v"])
        left, right = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
        alone = not t["pair"][0].as_py()  # one block with itself
        if alone:
            right = left
        n, root = np.zeros(len(node), np.int64), np.arange(len(node))
        edges: list[tuple[int, int]] = []
        for at in range(0, len(left), 1024):
            rows = left[at:at + 1024]
            i, j = np.nonzero(x[rows] @ x[right].T >= rule.cosine)
            i, j = rows[i], right[j]
            if alone:
                i, j = i[i < j], j[i < j]
            np.add.at(n, i, mult[j])
            np.add.at(n, j, mult[i])
            # vectors already connected in this unit need no further link
            edges += forest(len(node), i, j, root)
        e = np.array(edges, np.int64).reshape(-1, 2)
        seen = np.nonzero(n)[0]
        return pa.table({
            "node": pa.array(np.concatenate([node[seen], node[e[:, 0]]])),
            "n": pa.array(np.concatenate([n[seen], np.zeros(len(e), np.int64)])),
            "other": pa.array([None] * len(seen) + node[e[:, 1]].tolist(), pa.int64()),
        })

    return work


def linked_vectors(nodes: DataFrame, rule: RangeRule) -> DataFrame:
    """Per unit of work (node, n, other): summed multiplicities of linked nodes, and connecting links (n = 0)."""
    sample = nodes.orderBy(F.xxhash64(F.lit("pivot"), "node")).limit(rule.pivots).select("v", "dim").collect()
    common = max((r["dim"] for r in sample), key=[r["dim"] for r in sample].count, default=0)
    chosen = [r["v"] for r in sample if r["dim"] == common]
    pivots = units(pa.array(chosen)) if chosen else np.zeros((0, 0))
    placed = stage(assign_cells(nodes, pivots, rule))
    cells = placed.groupBy("dim", "cell").agg(F.count_if("home").alias("n_home"), F.count_if(~F.col("home")).alias("n_guest"))
    blocks = cells.select("dim", "cell", *[F.ceil(F.col(n) / rule.block).cast("int").alias(b) for n, b in (("n_home", "b_home"), ("n_guest", "b_guest"))]).where("b_home > 0")
    rows = placed.join(stage(blocks), ["dim", "cell"])
    mine = F.pmod(F.xxhash64(F.lit("block"), "node"), F.when(F.col("home"), F.col("b_home")).otherwise(F.col("b_guest"))).cast("int")
    rows = rows.withColumn("mine", mine)
    others = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))

    def unit(guests, a, b, side, pair):
        return F.struct(F.lit(guests).alias("guests"), a.alias("a"), b.alias("b"), side.cast("int").alias("side"), pair.alias("pair"))

    me = F.col("mine")
    at_home = F.concat(
        F.transform(others("b_home"), lambda o: unit(False, F.least(me, o), F.greatest(me, o), me > o, me != o)),
        F.transform(others("b_guest"), lambda o: unit(True, me, o, F.lit(0), F.lit(True))),
    )
    as_guest = F.transform(others("b_home"), lambda o: unit(True, o, me, F.lit(1), F.lit(True)))
    work = rows.withColumn("u", F.explode(F.when(F.col("home"), at_home).otherwise(as_guest))).select("dim", "cell", "u.*", "node", "mult", "v")
    return stage(work.groupBy("dim", "cell", "guests", "a", "b").applyInArrow(join_blocks(rule), "node long, n long, other long"))


def near_vectors(df: DataFrame, key: str, vector: str, rule: RangeRule = RangeRule()) -> DataFrame:
    """One row per input row: key, n_links (other rows linked directly), component_id, kept (the component's smallest key).

    Equal vectors are one node that weighs as many rows as it has. Vectors that are null, empty, zero or hold a null or
    non-finite component link with nothing; vectors of different lengths do not link. Cosines are computed in double
    precision on whole vectors. Rows may repeat; null keys are passed over as component ids. Other columns are not read.
    """
    raw = F.col(vector)
    good = raw.isNotNull() & (F.size(raw) > 0) & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(raw, lambda x: x != 0)
    clean = F.when(F.coalesce(good, F.lit(False)), F.transform(raw, lambda x: F.when(x == 0, F.lit(0.0).cast(df.schema[vector].dataType.elementType)).otherwise(x)))
    rows = df.select(F.col(key).alias("id"), clean.alias("v"))
    rows = stage(rows.select("id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit("second"), F.col("v")).alias("k2"), F.monotonically_increasing_id().alias("rid")))
    groups = stage(rows.where("v is not null").groupBy("k1", "k2").agg(F.min("rid").alias("node"), F.count(F.lit(1)).alias("mult"), F.min("id").alias("low")))
    nodes = stage(groups.join(rows.select(F.col("rid").alias("node"), "v"), "node").select("node", "mult", "v", F.size("v").alias("dim")))
    found = linked_vectors(nodes, rule)
    unstage(nodes)
    counts = found.where("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    edges = found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
    comps = stage(connected_components(groups.select("node"), edges, [], "node", "a", "b"))
    low = groups.join(comps, "node").groupBy("component").agg(F.min("low").alias("component_id"))
    of_node = groups.join(comps, "node").join(low, "component").join(counts, "node", "left")
    of_node = stage(of_node.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id"))
    back = rows.where("v is not null").select("id", "k1", "k2").join(of_node, ["k1", "k2"]).select("id", "n_links", "component_id")
    out = back.unionByName(rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
