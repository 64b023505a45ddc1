"""Ordered computations that hold when one key owns a large part of the rows.

A plain ``Window.partitionBy(capture)`` puts a whole capture into one task. Here the table is
range-partitioned by key and order instead, at the quantiles Spark samples for it, so that a
large key is cut into several slices of about equal size, whatever the type or the spread of its
order. The window runs per (key, slice), and one summary row per slice carries the state across
the cuts. There is one plan for tables of every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capstrata.session import SLICES_KEY, stage, unstage

SLICE = "_slice"
#: About so many rows go into a slice at most. Spark sizes partitions by compressed bytes, and sorted keys and positions
#: compress to a few bytes a row, so that a task would get and sort very many of them.
SLICE_ROWS = 500_000


def with_slices(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The table staged once with the slice number of each row; it rises with ``order`` within a key.

    There are as many slices as shuffle partitions, or as ``spark.capstrata.slices`` says; AQE
    merges small ones, and slices of too many rows are cut again. Rows equal in all keys and order
    columns share a slice.
    """
    return _slices(df, keys, order)[0]


def _slices(df: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, int]:
    """The sliced table and its number of rows."""
    wanted = df.sparkSession.conf.get(SLICES_KEY, None)
    ranged = df.repartitionByRange(int(wanted), *keys, *order) if wanted else df.repartitionByRange(*keys, *order)
    sliced = stage(ranged.withColumn(SLICE, F.spark_partition_id()))
    rows, most = sliced.groupBy(SLICE).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.max("count")).first()
    if not wanted and most and most > 2 * SLICE_ROWS:
        coarse = sliced
        finer = coarse.drop(SLICE).repartitionByRange(-(-rows // SLICE_ROWS), *keys, *order)
        sliced = stage(finer.withColumn(SLICE, F.spark_partition_id()))
        unstage(coarse)
    return sliced, rows


def sequence_over(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    rank: str | None = None,
    lag: dict[str, str] | None = None,
    lead: dict[str, str] | None = None,
    running_sum: dict[str, Column] | None = None,
    running_max_before: dict[str, Column] | None = None,
    total_sum: dict[str, Column] | None = None,
    total_min: dict[str, Column] | None = None,
) -> DataFrame:
    """Window results over ``order`` within ``keys``, exact across slices.

    ``rank`` is the 0-based position; ``lag``/``lead`` map output name to source column;
    ``running_sum`` includes the current row, ``running_max_before`` excludes it;
    ``total_sum`` and ``total_min`` cover the whole key. ``order`` must be a total order.
    """
    lag, lead = lag or {}, lead or {}
    running_sum, running_max_before = running_sum or {}, running_max_before or {}
    total_sum, total_min = total_sum or {}, total_min or {}
    sliced, rows = _slices(df, keys, order)
    position = F.struct(*order)

    parts = [F.count(F.lit(1)).alias("_c")]
    if lag:
        parts.append(F.max_by(F.struct(*[F.col(c).alias(o) for o, c in lag.items()]), position).alias("_last"))
    if lead:
        parts.append(F.min_by(F.struct(*[F.col(c).alias(o) for o, c in lead.items()]), position).alias("_first"))
    parts += [F.sum(e).alias(f"_s_{o}") for o, e in running_sum.items()]
    parts += [F.max(e).alias(f"_m_{o}") for o, e in running_max_before.items()]
    parts += [F.sum(e).alias(f"_t_{o}") for o, e in total_sum.items()]
    parts += [F.min(e).alias(f"_t_{o}") for o, e in total_min.items()]
    summary = sliced.groupBy(*keys, SLICE).agg(*parts)

    along = Window.partitionBy(*keys).orderBy(SLICE)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = []
    if rank:
        carried.append(F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset"))
    if lag:
        carried.append(F.lag("_last").over(along).alias("_prev"))
    if lead:
        carried.append(F.lead("_first").over(along).alias("_next"))
    carried += [F.sum(f"_s_{o}").over(before).alias(f"_s_{o}") for o in running_sum]
    carried += [F.max(f"_m_{o}").over(before).alias(f"_m_{o}") for o in running_max_before]
    carried += [F.sum(f"_t_{o}").over(whole).alias(o) for o in total_sum]
    carried += [F.min(f"_t_{o}").over(whole).alias(o) for o in total_min]
    # the windows below need this shuffle anyway; a broadcast would take a row per key through the driver
    if rows > SLICE_ROWS:  # a number of its own keeps AQE from merging partitions into tasks of very many rows
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * -(-rows // SLICE_ROWS))
        sliced = sliced.repartition(parts, *keys, SLICE)
    joined = sliced.join(summary.select(*keys, SLICE, *carried).hint("shuffle_hash"), [*keys, SLICE])

    within = Window.partitionBy(*keys, SLICE).orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    out = []
    place = F.row_number().over(within)
    if rank:
        out.append((F.col("_offset") + place - 1).alias(rank))
    if lag:
        # the first row of a slice takes the last row of the slice before it
        out += [F.when(place == 1, F.col(f"_prev.{o}")).otherwise(F.lag(c).over(within)).alias(o)
                for o, c in lag.items()]
    if lead:
        after = F.lead(F.lit(1)).over(within)
        out += [F.when(after.isNull(), F.col(f"_next.{o}")).otherwise(F.lead(c).over(within)).alias(o)
                for o, c in lead.items()]
    out += [(F.sum(e).over(upto) + F.coalesce(F.col(f"_s_{o}"), F.lit(0))).alias(o)
            for o, e in running_sum.items()]
    out += [F.greatest(F.max(e).over(earlier), F.col(f"_m_{o}")).alias(o)
            for o, e in running_max_before.items()]
    return joined.select(*df.columns, *out, *total_sum, *total_min)


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
              count: str | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per key, without buffering a large group in one task.

    Equal values are folded by a partial aggregate first, then the running count over the
    sliced value order locates the two neighbours of every wanted position.
    """
    folded = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_w"))
    spread = sequence_over(folded, keys, [value], running_sum={"_cum": F.col("_w")},
                           total_sum={"_total": F.col("_w")})
    picks = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        picks.append(F.min(F.when(F.col("_cum") > F.floor(at), F.col(value).cast("double"))).alias(f"_lo_{name}"))
        picks.append(F.min(F.when(F.col("_cum") > F.ceil(at), F.col(value).cast("double"))).alias(f"_hi_{name}"))
    found = spread.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks)
    out = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    if count:
        out.append(F.col("_total").alias(count))
    return found.select(*keys, *out)


def distribution(df: DataFrame, keys: list[str], value: str, prefix: str) -> DataFrame:
    """Count, median, 90th percentile and maximum per key."""
    q = quantiles(df, keys, value, {f"{prefix}_median": 0.5, f"{prefix}_p90": 0.9, f"{prefix}_max": 1.0},
                  count=f"{prefix}_count")
    return q


def runs_of(df: DataFrame, keys: list[str], bin_col: str, run: str = "run") -> DataFrame:
    """Gaps and islands over distinct integer bins: adjacent bins share the run's first bin."""
    bins = df.select(*keys, bin_col).distinct()
    seq = sequence_over(bins, keys, [bin_col], rank="_pos")
    seq = seq.withColumn("_island", F.col(bin_col) - F.col("_pos"))
    first = seq.groupBy(*keys, "_island").agg(F.min(bin_col).alias(run))
    return seq.join(first, [*keys, "_island"]).select(*keys, bin_col, run)


DIRECTIONS = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 1), (1, 1, -1), (1, -1, 1), (1, -1, -1)]


def group_diameter(df: DataFrame, keys: list[str], xyz: list[str], out: str) -> DataFrame:
    """Largest pairwise distance per group, exact, without forming all pairs.

    The extremes along the axes and space diagonals give a lower bound. A point whose farthest
    bounding-box corner is nearer than that bound cannot end a longest pair, so only the
    few points beyond it are compared.
    """
    x, y, z = (F.col(c) for c in xyz)
    points = df.select(*keys, *xyz).distinct()
    at = F.struct(*xyz)
    ends = []
    for i, (a, b, c) in enumerate(DIRECTIONS):
        along = a * x + b * y + c * z
        ends += [F.max_by(at, along).alias(f"_h{i}"), F.min_by(at, along).alias(f"_l{i}")]
    box = [f(c).alias(f"_{n}_{c}") for c in xyz for n, f in (("min", F.min), ("max", F.max))]
    stats = points.groupBy(*keys).agg(*ends, *box)

    def gap2(p, q):
        return sum((F.col(f"{p}.{c}") - F.col(f"{q}.{c}")) ** 2 for c in xyz)

    bound = F.greatest(*[gap2(f"_h{i}", f"_l{i}") for i in range(len(DIRECTIONS))])
    stats = stats.select(*keys, bound.alias("_bound"), *[f"_{n}_{c}" for c in xyz for n in ("min", "max")])
    reach = sum(F.greatest(F.abs(F.col(c) - F.col(f"_min_{c}")), F.abs(F.col(c) - F.col(f"_max_{c}"))) ** 2
                for c in xyz)
    outer = points.join(stats.where(F.col("_bound") > 0), keys).where(
        reach >= F.col("_bound") * (1 - 1e-12)).select(*keys, *xyz)
    other = outer.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in xyz])
    pair2 = sum((F.col(c) - F.col(f"_o_{c}")) ** 2 for c in xyz)
    longest = (outer.join(other, keys)
               .where(F.struct(*xyz) < F.struct(*[f"_o_{c}" for c in xyz]))
               .groupBy(*keys).agg(F.sqrt(F.max(pair2)).alias(out)))
    return stats.select(*keys).join(longest, keys, "left").select(
        *keys, F.coalesce(F.col(out), F.lit(0.0)).alias(out))


def with_diameter(df: DataFrame, points: str, xyz: list[str], out: str, few: int = 16) -> DataFrame:
    """Largest pairwise distance between the points of each row, an array of structs.

    For many small groups: gathering a group costs less than the extremes of ``group_diameter``, which
    each of its rows would carry. Of more than ``few`` points only those that may end a longest pair are compared.
    """
    def gap2(p, q):
        return sum((p[c] - q[c]) * (p[c] - q[c]) for c in xyz)

    def along(d):
        return F.transform(points, lambda p: F.struct(sum(k * p[c] for k, c in zip(d, xyz)).alias("_at"), p.alias("_p")))

    many = F.size(points) > few
    df = df.withColumn("_ends", F.when(many, F.array(*[F.struct(F.array_max(along(d))["_p"].alias("h"), F.array_min(along(d))["_p"].alias("l")) for d in DIRECTIONS])))
    df = df.withColumn("_bound", F.array_max(F.transform("_ends", lambda e: gap2(e["h"], e["l"]))))
    box = F.struct(*[f(f"{points}.{c}").alias(f"{n}_{c}") for c in xyz for n, f in (("min", F.array_min), ("max", F.array_max))])
    df = df.withColumn("_box", F.when(many, box))
    reach = lambda p: sum(F.greatest(F.abs(p[c] - F.col(f"_box.min_{c}")), F.abs(p[c] - F.col(f"_box.max_{c}"))) ** 2 for c in xyz)
    df = df.withColumn("_outer", F.when(many, F.filter(points, lambda p: reach(p) >= F.col("_bound") * (1 - 1e-12))).otherwise(F.col(points)))
    longest = F.array_max(F.transform("_outer", lambda p: F.array_max(F.transform("_outer", lambda q: gap2(p, q)))))
    return df.withColumn(out, F.coalesce(F.sqrt(longest), F.lit(0.0))).drop("_ends", "_bound", "_box", "_outer")
