"""Range joins by time buckets, sweeps over interval ends, and statistics over closed intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capstrata.operators.ordered import sequence_over
from capstrata.session import stage


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], time: str,
                  start: str, end: str, width: float, how: str = "inner") -> DataFrame:
    """Points inside closed intervals, as an equi-join on (keys, bucket).

    An interval is repeated once per bucket it touches and a point has exactly one bucket,
    so no pair appears twice. Take the usual interval length as ``width``.
    """
    bucket = lambda c: F.floor(F.col(c).cast("double") / width)
    spread = intervals.withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    placed = points.withColumn("_bucket", bucket(time))
    on = [F.col(f"p.{k}") == F.col(f"i.{k}") for k in [*keys, "_bucket"]]
    t = F.col(f"p.{time}").cast("double")
    inside = (t >= F.col(f"i.{start}").cast("double")) & (t <= F.col(f"i.{end}").cast("double"))
    cond = inside
    for c in on:
        cond = cond & c
    joined = placed.alias("p").join(spread.alias("i"), cond, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_bucket")
    extra = [F.col(f"i.{c}") for c in intervals.columns if c not in keys]
    return joined.select(*[F.col(f"p.{c}") for c in points.columns], *extra)


def swept(points: DataFrame, intervals: DataFrame, keys: list[str], ident: list[str], time: str, row: str,
          start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """Points with their position `_pos` in time order, and (keys, ident, _lo, _hi): the positions each closed interval holds.

    One sweep over points and interval ends, range-partitioned by key and time; the count of points before each slice is
    carried across the cuts. So an interval costs two rows however many points or slices it spans. Intervals whose ends
    are null or reversed hold nothing. Points that tie are ordered by `row`.
    """
    at = lambda c: F.col(c).cast("double")
    point = F.struct(*[F.col(c) for c in points.columns if c not in keys])
    name = F.struct(*ident)
    rows = points.where(F.col(time).isNotNull()).select(*keys, at(time).alias("_at"), F.lit(1).alias("_kind"), F.col(row).cast("bigint").alias("_row"), name_of(intervals, ident), point.alias("_p"))
    nothing = F.lit(None).cast(rows.schema["_p"].dataType).alias("_p")
    ends = [intervals.where(F.col(start) <= F.col(end)).select(*keys, at(c).alias("_at"), F.lit(kind).alias("_kind"), F.lit(None).cast("bigint").alias("_row"), name.alias("_id"), nothing)
            for c, kind in ((start, 0), (end, 2))]
    placed = stage(sequence_over(rows.unionByName(ends[0]).unionByName(ends[1]), keys, ["_at", "_kind", "_row", "_id"], running_sum={"_seen": F.when(F.col("_kind") == 1, 1).otherwise(0)}))
    held = placed.where("_kind <> 1").groupBy(*keys, "_id").agg(F.max(F.when(F.col("_kind") == 0, F.col("_seen"))).alias("_lo"), F.max(F.when(F.col("_kind") == 2, F.col("_seen"))).alias("_hi"))
    return placed.where("_kind = 1").select(*keys, "_p.*", (F.col("_seen") - 1).alias("_pos")), held.select(*keys, "_id.*", "_lo", "_hi")


def name_of(intervals: DataFrame, ident: list[str]) -> Column:
    return F.lit(None).cast(intervals.select(F.struct(*ident).alias("_id")).schema["_id"].dataType).alias("_id")


#: Samples a block of the next level holds, and levels above single samples.
RADIX, LEVELS = 256, 2


def covering_blocks(held: DataFrame) -> DataFrame:
    """One row per block of the fewest aligned blocks (_level, _index) that make up the positions _lo .. _hi - 1."""
    spans, rows = [], held.withColumns({"_a": F.col("_lo").cast("bigint"), "_b": F.col("_hi").cast("bigint")})
    for level in range(LEVELS + 1):
        a, b = F.col(f"_a{level}"), F.col(f"_b{level}")
        up, down = F.ceil(F.col("_a") / RADIX).cast("bigint"), F.floor(F.col("_b") / RADIX).cast("bigint")
        none = F.lit(0).cast("bigint")
        rows = rows.withColumns({f"_a{level}": F.col("_a"), f"_b{level}": F.col("_b"), f"_u{level}": up if level < LEVELS else none, f"_d{level}": down if level < LEVELS else none})
        up, down = F.col(f"_u{level}"), F.col(f"_d{level}")
        span = lambda x, y, k: F.struct(F.lit(k).alias("level"), x.alias("x"), y.alias("y"))
        spans += [span(a, F.when(up < down, up * RADIX).otherwise(b), level), span(F.when(up < down, down * RADIX).otherwise(b), b, level)]
        rows = rows.withColumns({"_a": F.when(up < down, up).otherwise(none), "_b": F.when(up < down, down).otherwise(none)})
    found = rows.select(*held.columns, F.explode(F.array(*spans)).alias("_s")).where("_s.x < _s.y")
    return found.select(*held.columns, F.col("_s.level").alias("_level"), F.explode(F.sequence(F.col("_s.x"), F.col("_s.y") - 1)).alias("_index"))


def interval_stats(samples: DataFrame, intervals: DataFrame, keys: list[str], ident: list[str], magnitude: Column) -> DataFrame:
    """Count, row range, first and last time, RMS and maximum magnitude per closed interval.

    ``samples`` has sensor time ``t`` and ``source_row``; ``intervals`` has ``ident``, ``start`` and ``end``. Empty
    intervals keep their row position and NULL statistics. Samples are summed up in aligned blocks of 256 and 256^2
    positions, and an interval joins the few blocks it is made of: its rows grow with the logarithm of the samples in it.
    """
    points, held = swept(samples.select(*keys, "t", "source_row", magnitude.alias("_mag")), intervals, keys, ident, "t", "source_row", "start", "end")
    block = points.select(*keys, F.lit(0).alias("_level"), F.col("_pos").alias("_index"), F.lit(1).cast("bigint").alias("_n"), F.col("t").cast("double").alias("_first"),
                          F.col("t").cast("double").alias("_last"), (F.col("_mag") * F.col("_mag")).alias("_square"), F.col("_mag").alias("_top"))
    sums = [F.sum("_n").alias("_n"), F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.sum("_square").alias("_square"), F.max("_top").alias("_top")]
    blocks, below = block, block
    for level in range(1, LEVELS + 1):
        below = stage(below.groupBy(*keys, F.floor(F.col("_index") / RADIX).cast("bigint").alias("_index")).agg(*sums).withColumn("_level", F.lit(level)))
        blocks = blocks.unionByName(below)
    wanted = covering_blocks(held).select(*keys, *ident, "_level", "_index")
    stats = wanted.join(blocks, [*keys, "_level", "_index"]).groupBy(*keys, *ident).agg(
        F.sum("_n").alias("sample_count"), F.min("_first").alias("first_sample_sec"), F.max("_last").alias("last_sample_sec"),
        F.sqrt(F.sum("_square") / F.sum(F.when(F.col("_square").isNotNull(), F.col("_n")))).alias("rms_magnitude"), F.max("_top").alias("maximum_magnitude"))
    reach = samples.groupBy(*keys).agg(F.min("t").cast("double").alias("_first"), F.max("t").cast("double").alias("_end"))
    out = intervals.join(held, [*keys, *ident], "left").join(stats, [*keys, *ident], "left").join(reach, keys, "left")
    n, lo = F.coalesce("sample_count", F.lit(0)), F.coalesce("_lo", F.lit(0)).cast("bigint")
    return out.select(
        *keys, *ident, n.alias("sample_count"), lo.alias("range_start"), (lo + n).alias("range_end"),
        F.coalesce((F.col("_first") <= F.col("start")) & (F.col("end") <= F.col("_end")), F.lit(False)).alias("boundary_covered"),
        "first_sample_sec", "last_sample_sec", "rms_magnitude", "maximum_magnitude")


def annotation_windows(frames: DataFrame, annotations: DataFrame) -> DataFrame:
    """Frames inside each declared window, with the sorted object ids per frame.

    A window takes part with the positions of the frames it holds, so it makes as many rows as it has frames. Rows that
    repeat an object's window count once.
    """
    points, held = swept(frames.select("capture_id", "rank", "relative_sec"), annotations, ["capture_id"], ["object_id", "start_sec", "end_sec"], "relative_sec", "rank", "start_sec", "end_sec")
    inside = held.where("_lo < _hi").select("capture_id", "object_id", F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1)).alias("_pos"))
    return inside.join(points, ["capture_id", "_pos"]).groupBy("capture_id", "rank").agg(
        F.count(F.lit(1)).alias("objects"),
        F.array_join(F.transform(F.array_sort(F.collect_list("object_id")), lambda i: F.format_string("%010d", i)), ";").alias("object_ids"))


def unmatched_windows(frames: DataFrame, annotations: DataFrame) -> DataFrame:
    """Windows that meet no frame, which the annotation contract refuses."""
    _, held = swept(frames.select("capture_id", "rank", "relative_sec"), annotations, ["capture_id"], ["object_id", "start_sec", "end_sec"], "relative_sec", "rank", "start_sec", "end_sec")
    return annotations.join(held.where("_lo < _hi"), ["capture_id", "object_id"], "left_anti").select(
        "capture_id", "object_id", F.lit("INVALID_ANNOTATION").alias("code"))
