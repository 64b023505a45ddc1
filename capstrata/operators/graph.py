"""Iterative graph operators on edge tables keyed by capture.

Every round is staged to the shared folder, so the plan stays one round deep and a lost
executor never replays earlier rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capstrata.session import stage, unstage

#: Edges that a task contracts at once.
CHUNK = 200_000


def _signature(df: DataFrame) -> tuple:
    total = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))
    return tuple(df.agg(F.count(F.lit(1)), total).first())


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest vertex of the component of each of n vertices."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return root
        low = np.minimum(ra, rb)
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while (root[root] != root).any():
            root = root[root]


def contracted(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (keys, u, v) replaced, chunk by chunk, by a star from each vertex to the smallest one it reaches there.

    Any chunk of edges may be replaced by such stars without changing a component. Edges of a capture
    are dealt to one task and sorted, but a large capture may be split over tasks and chunks; ``_chunk``
    names the chunk, so a capture met in one chunk only is finished.
    """
    names = [*keys, "u", "v"]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in edges.select(*names).schema], T.StructField("_chunk", T.LongType())])

    def star(table: pa.Table, chunk: int) -> pa.RecordBatch:
        group = np.zeros(len(table), dtype=np.int64)
        for key in keys:
            code = table[key].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            group = np.unique(group * (int(code.max()) + 1) + code, return_inverse=True)[1]
        ends = [table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in "uv"]
        values, spot = np.unique(np.concatenate(ends), return_inverse=True)
        vertex, at = np.unique(np.concatenate([group, group]) * len(values) + spot, return_inverse=True)
        root = _roots(len(vertex), at[:len(table)], at[len(table):])
        row = np.empty(len(vertex), dtype=np.int64)
        row[at] = np.concatenate([np.arange(len(table))] * 2)
        kept = np.flatnonzero(root != np.arange(len(vertex)))
        out = [table[key].combine_chunks().take(pa.array(row[kept])) for key in keys]
        out += [pa.array(values[vertex[v] % len(values)], type=table[c].type) for c, v in (("u", kept), ("v", root[kept]))]
        return pa.RecordBatch.from_arrays([*out, pa.array(np.full(len(kept), chunk))], names=[*names, "_chunk"])

    def contract(batches):
        held, rows, chunk = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                yield star(pa.Table.from_batches(held), chunk)
                held, rows, chunk = [], 0, chunk + 1
        if rows:
            yield star(pa.Table.from_batches(held), chunk)

    return edges.select(*names).hint("rebalance", *keys).sortWithinPartitions(*keys).mapInArrow(contract, schema)


def connected_components(vertices: DataFrame, edges: DataFrame, keys: list[str], vertex: str,
                         a: str, b: str) -> DataFrame:
    """Smallest vertex of each component.

    Integer vertices are first contracted in chunks of edges. Captures that lie in one chunk are finished by
    that; only the others go on to the rounds, as does a single graph without keys.
    """
    e = edges.select(*keys, F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    if not keys or not isinstance(e.schema["u"].dataType, T.IntegralType):
        label = _star_rounds(e.distinct(), keys)
    else:
        e = e.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
        stars = stage(contracted(e, keys))
        parted = stage(stars.groupBy(*keys).agg(F.min("_chunk").alias("_a"), F.max("_chunk").alias("_b")).where("_a <> _b").select(*keys))
        rest = stars.drop("_chunk").distinct()
        label = rest.join(parted, keys, "left_anti").unionByName(_star_rounds(rest.join(parted, keys, "left_semi"), keys))
    label = label.select(*keys, F.col("u").alias(vertex), F.col("v").alias("component"))
    return vertices.select(*keys, vertex).distinct().join(label, [*keys, vertex], "left").select(
        *keys, vertex, F.coalesce("component", vertex).alias("component"))


def _star_rounds(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct edges (keys, u, v) turned into stars to the smallest vertex by large-star and small-star steps.

    Both steps reduce with a map-side minimum and join it back, so a hub vertex is never
    collected; the number of rounds grows with the logarithm of the component size.
    """
    e = stage(edges)
    before = _signature(e)
    while before[0]:
        both = e.union(e.select(*keys, F.col("v"), F.col("u"))).distinct()
        low = both.groupBy(*keys, "u").agg(F.min("v").alias("_m")).select(
            *keys, "u", F.least("u", "_m").alias("_m"))
        large = both.join(low, [*keys, "u"]).where("v > u").select(*keys, F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        down = large.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy(*keys, "u").agg(F.min("v").alias("_m"))
        small = down.join(least, [*keys, "u"]).where("v <> _m").select(*keys, F.col("v").alias("u"), F.col("_m").alias("v"))
        last, e = e, stage(small.union(least.select(*keys, "u", F.col("_m").alias("v"))).distinct())
        unstage(last)
        after = _signature(e)
        if after == before:
            break
        before = after
    return e


def component_sizes(components: DataFrame, keys: list[str]) -> DataFrame:
    return components.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("size"))


def k_core(edges: DataFrame, keys: list[str], a: str, b: str, k: int = 2, fixed: DataFrame | None = None) -> DataFrame:
    """Vertices left after repeatedly dropping those with fewer than k neighbours.

    Vertices of ``fixed`` (keys, vertex) are known to stay; edges between two of them are not looked at.
    """
    e = edges.select(*keys, F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = e.union(e.select(*keys, F.col("v"), F.col("u"))).distinct()
    if fixed is None:
        e = stage(e.withColumn("_stays", F.lit(False)))
    else:
        stays = fixed.select(*keys, F.col("vertex").alias("u"), F.lit(True).alias("_stays")).distinct()
        known = stage(e.join(stays, [*keys, "u"], "left").withColumn("_stays", F.coalesce("_stays", F.lit(False))))
        both = known.where("_stays").select(*keys, F.col("u").alias("v"), F.col("v").alias("u"))
        e = stage(known.join(both.withColumn("_stays", F.lit(True)), [*keys, "u", "v", "_stays"], "left_anti"))
        unstage(known)
    staged, size = e, e.count()
    while True:
        for _ in range(2):  # two peels per staged round
            keep = e.groupBy(*keys, "u").agg(F.count(F.lit(1)).alias("_d"), F.max("_stays").alias("_s")).where((F.col("_d") >= k) | F.col("_s")).select(*keys, "u")
            e = e.join(keep, [*keys, "u"], "left_semi").join(
                keep.withColumnRenamed("u", "v"), [*keys, "v"], "left_semi").select(*keys, "u", "v", "_stays")
        last, e = staged, stage(e)
        staged = e
        unstage(last)
        left = e.count()
        if left == size:
            break
        size = left
    out = e.where("NOT _stays").select(*keys, F.col("u").alias("vertex")).distinct()
    return out if fixed is None else out.unionByName(fixed.select(*keys, "vertex").distinct())


def grid_neighbors(cells: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Each cell with its occupied 8-neighbours, by an equi-join on shifted coordinates."""
    offsets = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"))
                        for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    shifted = cells.select(*keys, x, y, F.explode(offsets).alias("_o")).select(
        *keys, x, y, (F.col(x) + F.col("_o.dx")).alias("nx"), (F.col(y) + F.col("_o.dy")).alias("ny"))
    there = cells.select(*keys, F.col(x).alias("nx"), F.col(y).alias("ny"))
    return shifted.join(there, [*keys, "nx", "ny"])


def cell_components(cells: DataFrame, keys: list[str], x: str = "cx", y: str = "cy") -> DataFrame:
    """8-connected components of grid cells, named by their smallest cell."""
    links = grid_neighbors(cells, keys, x, y).select(
        *keys, F.struct(F.col(x).alias("x"), F.col(y).alias("y")).alias("a"),
        F.struct(F.col("nx").alias("x"), F.col("ny").alias("y")).alias("b"))
    spots = cells.select(*keys, F.struct(F.col(x).alias("x"), F.col(y).alias("y")).alias("cell"))
    found = connected_components(spots, links, keys, "cell", "a", "b")
    return found.select(*keys, F.col("cell.x").alias(x), F.col("cell.y").alias(y),
                        F.col("component.x").alias("root_x"), F.col("component.y").alias("root_y"))
