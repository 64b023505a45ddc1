"""Clock association, stream statistics and event detection on ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capstrata.functions import geometry as G
from capstrata.operators.ordered import quantiles, sequence_over
from capstrata.policies import IngestPolicy

POSE = [f"w{i}{j}" for i in range(3) for j in range(3)]


def nonmonotonic_rows(samples: DataFrame, keys: list[str], time: str = "sensor_sec",
                      order: str = "source_row", code: str = "NONMONOTONIC_TIME") -> DataFrame:
    """Rows whose time does not exceed the row before; the rows themselves stay untouched."""
    seq = sequence_over(samples, keys, [order], lag={"previous": time})
    return seq.where(F.col(time) <= F.col("previous")).select(
        *keys, order, time, "previous", F.lit(code).alias("code"))


def sequence_violations(rows: DataFrame, keys: list[str], index: str, increasing: list[str]) -> DataFrame:
    """Index must be 0,1,2,... and each listed column must rise; one row per broken rule."""
    seq = sequence_over(rows, keys, [index], rank="_place", lag={f"_p_{c}": c for c in increasing})
    rules = [F.when(F.col(index) != F.col("_place"), F.lit("FRAME_ID_MISMATCH"))]
    rules += [F.when(F.col(c) <= F.col(f"_p_{c}"), F.lit(f"NONMONOTONIC_{c.upper()}")) for c in increasing]
    return seq.select(*keys, index, F.explode(F.array_compact(F.array(*rules))).alias("code"))


def slot_gaps(frames: DataFrame) -> DataFrame:
    """Recording-slot discontinuities between neighbouring frames."""
    seq = sequence_over(frames, ["capture_id"], ["rank"], lag={"_slot": "slot", "_sec": "sensor_sec"})
    return seq.where(F.col("slot") > F.col("_slot") + 1).select(
        "capture_id", (F.col("rank") - 1).alias("before_frame"), F.col("rank").alias("after_frame"),
        (F.col("slot") - F.col("_slot") - 1).alias("skipped_slots"),
        (F.col("sensor_sec") - F.col("_sec")).cast("decimal(20,6)").alias("interval_sec"))


def pose_speed_events(poses: DataFrame, threshold_m_s: float) -> DataFrame:
    """Neighbouring frames whose apparent speed exceeds the limit; diagnosis stays open."""
    seq = sequence_over(poses.select("capture_id", "rank", "sensor_sec", "relative_sec", "px", "py", "pz"), ["capture_id"], ["rank"],
                        lag={"_px": "px", "_py": "py", "_pz": "pz", "_sec": "sensor_sec"})
    step = G.norm(G.minus(G.vec("px", "py", "pz"), G.vec("_px", "_py", "_pz")))
    seq = seq.withColumn("step_m", step).withColumn(
        "speed_m_s", F.try_divide(F.col("step_m"), (F.col("sensor_sec") - F.col("_sec")).cast("double")))
    return seq.where(F.col("speed_m_s") > threshold_m_s).select(
        "capture_id", (F.col("rank") - 1).alias("first_rank"), F.col("rank").alias("second_rank"),
        F.col("relative_sec").cast("double").alias("seconds"), "step_m", "speed_m_s")


def gap_events(frames: DataFrame, speed_m_s: float) -> DataFrame:
    """Non-rising times, slot gaps and speed events in one pass: (capture_id, rank, code, amount)."""
    names = {f"_{c}": c for c in ("slot", "sec", "px", "py", "pz")}
    seq = sequence_over(frames.select("capture_id", "rank", *names.values()), ["capture_id"], ["rank"], lag=names)
    step = (F.col("sec") - F.col("_sec")).cast("double")
    speed = G.norm(G.minus(G.vec("px", "py", "pz"), G.vec("_px", "_py", "_pz"))) / F.when(step > 0, step)
    skipped = F.col("slot") - F.col("_slot") - 1
    event = lambda hit, code, amount: F.when(hit, F.struct(F.lit(code).alias("code"), amount.cast("double").alias("amount")))
    found = F.array_compact(F.array(event(step <= 0, "NONMONOTONIC_TIME", step), event(skipped > 0, "SLOT_GAP", skipped), event(speed > speed_m_s, "POSE_SPEED", speed)))
    return seq.select("capture_id", "rank", F.explode(found).alias("_e")).select("capture_id", "rank", "_e.code", "_e.amount")


def histogram_change(frames: DataFrame, histogram: str = "histogram") -> DataFrame:
    """Half the L1 distance to the histogram of the frame before; NULL for the first."""
    seq = sequence_over(frames, ["capture_id"], ["rank"], lag={"_before": histogram})
    gaps = F.zip_with(histogram, "_before", lambda a, b: F.abs(a - b))
    change = F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v) / 2
    return seq.select("capture_id", "rank", F.when(F.col("_before").isNotNull(), change).alias("change"))


def capture_origins(frames: DataFrame) -> DataFrame:
    return frames.groupBy("capture_id").agg(F.min("sensor_sec").alias("origin_sec"),
                                            F.max("sensor_sec").alias("last_sec"))


def stream_timing(samples: DataFrame, origins: DataFrame) -> DataFrame:
    """Coverage and rate of each native stream; nothing is interpolated."""
    keys = ["capture_id", "stream"]
    seq = sequence_over(samples, keys, ["source_row"], lag={"_before": "sensor_sec"})
    seq = seq.withColumn("interval", (F.col("sensor_sec") - F.col("_before")).cast("decimal(20,6)"))
    spread = seq.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.min("sensor_sec").alias("first_sec"),
                                    F.max("sensor_sec").alias("end_sec"), F.max("interval").alias("maximum_interval_sec"))
    middle = quantiles(seq, keys, "interval", {"median_interval_sec": 0.5})
    joined = spread.join(middle, keys, "left").join(origins, "capture_id")
    length = (F.col("end_sec") - F.col("first_sec")).cast("double")
    return joined.select(
        *keys, "samples", (F.col("first_sec") - F.col("origin_sec")).cast("double").alias("relative_start_sec"),
        (F.col("end_sec") - F.col("origin_sec")).cast("double").alias("relative_end_sec"),
        "median_interval_sec", F.col("maximum_interval_sec").cast("double").alias("maximum_interval_sec"),
        F.when(length > 0, (F.col("samples") - 1) / length).alias("effective_rate_hz"))


def boundary_coverage(samples: DataFrame, frames: DataFrame) -> DataFrame:
    """Whether each sensor stream spans the camera's time range."""
    spans = samples.groupBy("capture_id", "stream").agg(
        F.min("sensor_sec").alias("first_sec"), F.max("sensor_sec").alias("end_sec"))
    j = spans.join(capture_origins(frames), "capture_id")
    apart = (F.col("first_sec") > F.col("last_sec")) | (F.col("end_sec") < F.col("origin_sec"))
    partial = (F.col("first_sec") > F.col("origin_sec")) | (F.col("end_sec") < F.col("last_sec"))
    return j.select("capture_id", "stream", F.when(apart, "NO_IMU_CAMERA_OVERLAP")
                    .when(partial, "PARTIAL_IMU_BOUNDARY_COVERAGE").otherwise("COVERED").alias("status"))


def state_counts(frames: DataFrame) -> DataFrame:
    return frames.groupBy("capture_id", "tracking_state").agg(F.count(F.lit(1)).alias("frames"))


def constant_clock(frames: DataFrame, media: DataFrame, policy: IngestPolicy = IngestPolicy(),
                   num: int = 1, den: int = 1_000_000) -> DataFrame:
    """Decoded rank i belongs to frame i; the clocks may differ only by a constant.

    Both sides are exact integers of 1/den seconds, so the tolerance test never sees a float.
    One aggregate is enough: the residual is the distance to the offset of rank 0.
    """
    pairs = frames.join(media.withColumnRenamed("decoded_rank", "rank"), ["capture_id", "rank"], "full_outer")
    t = (F.col("sensor_sec") * den).cast("decimal(38,0)")
    offset = t - F.col("ticks").cast("decimal(38,0)") * num
    agg = pairs.groupBy("capture_id").agg(
        F.count("sensor_sec").alias("frame_rows"), F.count("ticks").alias("decoded_rows"),
        F.min_by(offset, F.col("rank")).alias("_zero"), F.min(offset).alias("_low"), F.max(offset).alias("_high"))
    worst = F.greatest(F.col("_high") - F.col("_zero"), F.col("_zero") - F.col("_low"))
    # the tolerance goes in as exact ticks; comparing a decimal with a float would round
    tolerance = int(round(policy.clock_tolerance_seconds * den))
    return agg.select(
        "capture_id", "frame_rows", "decoded_rows", worst.cast("bigint").alias("maximum_residual_ticks"),
        (F.col("_zero").cast("double") / den).alias("origin_offset_sec"),
        F.when(F.col("frame_rows") != F.col("decoded_rows"), "FRAME_COUNT_MISMATCH")
        .when(worst > tolerance, "FRAME_CLOCK_MISMATCH").otherwise("ASSOCIATED").alias("status"))


def affine_clock(frames: DataFrame, media: DataFrame, policy: IngestPolicy = IngestPolicy(),
                 seconds_per_tick: float = 1e-6) -> DataFrame:
    """Decoded rank i belongs to frame i+1 after one initial discard, under an affine clock."""
    shifted = media.select("capture_id", (F.col("decoded_rank") + 1).alias("rank"), "ticks")
    pairs = frames.select("capture_id", "rank", "sensor_sec").join(shifted, ["capture_id", "rank"])
    base = pairs.groupBy("capture_id").agg(F.min_by("ticks", "rank").alias("_t0"),
                                           F.min_by("sensor_sec", "rank").alias("_s0"))
    xy = pairs.join(base, "capture_id").select(
        "capture_id", ((F.col("ticks") - F.col("_t0")) * seconds_per_tick).alias("x"),
        (F.col("sensor_sec") - F.col("_s0")).cast("double").alias("y"))
    fit = xy.groupBy("capture_id").agg(F.regr_slope("y", "x").alias("slope"),
                                       F.regr_intercept("y", "x").alias("intercept"), F.count("*").alias("matched"))
    worst = xy.join(fit, "capture_id").groupBy("capture_id").agg(
        F.max(F.abs(F.col("y") - (F.col("intercept") + F.col("slope") * F.col("x")))).alias("maximum_residual_sec"))
    rows = frames.groupBy("capture_id").agg(F.count("*").alias("frame_rows"))
    ok = (F.abs(F.col("slope") - 1) <= policy.affine_slope_tolerance) & (
        F.col("maximum_residual_sec") <= policy.affine_residual_seconds)
    return rows.join(fit, "capture_id", "left").join(worst, "capture_id", "left").select(
        "capture_id", "frame_rows", F.coalesce("matched", F.lit(0)).alias("matched"), "slope", "intercept",
        "maximum_residual_sec",
        F.when(F.coalesce("matched", F.lit(0)) != F.col("frame_rows") - 1, "FRAME_COUNT_MISMATCH")
        .when(F.col("matched") < 3, "NONMONOTONIC_PTS")
        .when(ok, "ASSOCIATED").otherwise("FRAME_CLOCK_MISMATCH").alias("status"))


def unassociated_frames(frames: DataFrame, media: DataFrame) -> DataFrame:
    """Source rows without a decoded frame; they are kept and named."""
    return frames.join(media.select("capture_id", (F.col("decoded_rank") + 1).alias("rank")),
                       ["capture_id", "rank"], "left_anti").select("capture_id", "rank")


def stage_durations(history: DataFrame) -> DataFrame:
    """Time until the next stage of the same job starts; NULL for the open stage."""
    seq = sequence_over(history, ["job_id"], ["started_sec", "seq"], lead={"_next": "started_sec"})
    return seq.select("job_id", "seq", "stage", (F.col("_next") - F.col("started_sec")).cast("double").alias("seconds"))


def exposure_findings(frames: DataFrame, requested_cap: Column) -> DataFrame:
    """Frames exposed longer than the requested cap, counted per capture."""
    over = frames.where(F.col("exposure_sec") > requested_cap)
    return over.groupBy("capture_id").agg(F.count("*").alias("frames"), F.min("rank").alias("first_rank")).select(
        "capture_id", F.lit("EXPOSURE_EXCEEDS_REQUESTED_CAP").alias("code"), F.lit("WARNING").alias("severity"),
        "frames", "first_rank")


# What the two standing findings of a capture say.
UNSCALED = "dimensions_source=USER_REPORTED;scale_applied=false"
UNVERIFIED = "RGB_IMU_synchronization=UNVERIFIED;camera_IMU_extrinsics=UNVERIFIED;metric_accuracy=UNVERIFIED"


def capture_findings(frames: DataFrame, settings: DataFrame, annotations: DataFrame) -> DataFrame:
    """Limitations of each capture; no measurement is changed.

    ``settings`` has capture_id and requested_cap (null: none was requested). Frames exposed longer than the cap are counted
    with the first of them, declared objects are no localized scale, and physical calibration is never verified here.
    """
    k = "capture_id"
    over = F.col("exposure_sec") > F.col("requested_cap")
    seen = frames.select(k, "rank", "exposure_sec").join(settings.select(k, "requested_cap"), k, "left").groupBy(k).agg(
        F.count_if(over).alias("frames"), F.min(F.when(over, F.col("rank"))).alias("first_rank"), F.max("requested_cap").alias("requested_cap"))
    declared = annotations.groupBy(k).agg(F.count(F.lit(1)).alias("objects"))
    none = F.lit(None)

    def finding(code, details, frames=none, first=none, cap=none, objects=none):
        return F.struct(F.lit(code).alias("code"), F.lit("WARNING").alias("severity"), F.lit(details).alias("details"), frames.cast("bigint").alias("frames"),
                        first.cast("bigint").alias("first_rank"), cap.cast("double").alias("requested_cap"), objects.cast("bigint").alias("objects"))

    found = F.array_compact(F.array(
        F.when(F.col("frames") > 0, finding("EXPOSURE_EXCEEDS_REQUESTED_CAP", "observations_retained=true", F.col("frames"), F.col("first_rank"), F.col("requested_cap"))),
        F.when(F.col("objects") > 0, finding("SCALE_PRIOR_NOT_LOCALIZED", UNSCALED, objects=F.col("objects"))),
        finding("PHYSICAL_CALIBRATION_UNVERIFIED", UNVERIFIED)))
    return seen.join(declared, k, "left").select(k, F.explode(found).alias("_f")).select(k, "_f.*")
