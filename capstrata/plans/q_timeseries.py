"""Queries over frames, poses and sensor samples.

A user's events lie hours apart, so policies are scaled in time; operators keep the
contract's defaults.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from capstrata.functions.numeric import round6
from capstrata.operators import intervals as iv
from capstrata.operators import selection as sel
from capstrata.operators import timeseries as ts
from capstrata.plans.registry import query, r3, r6
from capstrata.policies import SelectionPolicy
from capstrata.session import stage

POLICY = SelectionPolicy(candidate_fps=0.0001, max_gap_seconds=200000.0, translation_m=0.30, rotation_degrees=60.0,
                         pose_speed_warning_m_s=0.0001, gyro_warning_rad_s=80.0,
                         gyro_half_window_seconds=4500.0, event_context_seconds=18000.0)


def r6c(*names):
    return [round6(F.col(n).cast("double")).alias(n) for n in names]


def round3(c):
    return F.floor(c * 1e3 + 0.5003).cast("double") / F.lit(1e3)


# --- ordered checks ---------------------------------------------------------

@query("nonmonotonic_rows", "order_stream", sql=f"""
    SELECT capture_id, source_row, {r6('CAST(sensor_sec AS DOUBLE)')} AS sensor_sec,
           {r6('CAST(previous AS DOUBLE)')} AS previous, 'NONMONOTONIC_TIME' AS code
    FROM (SELECT *, lag(sensor_sec) OVER (PARTITION BY capture_id ORDER BY source_row) AS previous FROM order_stream)
    WHERE sensor_sec <= previous""")
def nonmonotonic_rows(v):
    out = ts.nonmonotonic_rows(v.order_stream, ["capture_id"])
    return out.select("capture_id", "source_row", *r6c("sensor_sec", "previous"), "code")


@query("sequence_violations", "frames", sql="""
    SELECT capture_id, rank, code FROM (
      SELECT capture_id, rank, CASE WHEN k <= lag(k) OVER (PARTITION BY capture_id ORDER BY rank)
        THEN 'NONMONOTONIC_K' END AS code FROM frames) WHERE code IS NOT NULL""")
def sequence_violations(v):
    return ts.sequence_violations(v.frames, ["capture_id"], "rank", ["slot", "sensor_sec", "k"])


@query("slot_gaps", "frames", sql=f"""
    SELECT capture_id, rank - 1 AS before_frame, rank AS after_frame, slot - before - 1 AS skipped_slots,
           {r6('CAST(sensor_sec - sec AS DOUBLE)')} AS interval_sec
    FROM (SELECT *, lag(slot) OVER w AS before, lag(sensor_sec) OVER w AS sec FROM frames
          WINDOW w AS (PARTITION BY capture_id ORDER BY rank)) WHERE slot > before + 1""")
def slot_gaps(v):
    out = ts.slot_gaps(v.frames)
    return out.select("capture_id", "before_frame", "after_frame", "skipped_slots", *r6c("interval_sec"))


SPEED = """SELECT capture_id, rank - 1 AS first_rank, rank AS second_rank, CAST(relative_sec AS DOUBLE) AS seconds,
    step AS step_m, step / CAST(sensor_sec - sec AS DOUBLE) AS speed_m_s FROM
    (SELECT *, sqrt((px - lag(px) OVER w)*(px - lag(px) OVER w) + (py - lag(py) OVER w)*(py - lag(py) OVER w)
        + (pz - lag(pz) OVER w)*(pz - lag(pz) OVER w)) AS step, lag(sensor_sec) OVER w AS sec FROM frame_poses
     WINDOW w AS (PARTITION BY capture_id ORDER BY rank))
    WHERE step / CAST(sensor_sec - sec AS DOUBLE) > 0.0001"""


@query("pose_speed_events", "frame_poses", sql=f"""SELECT capture_id, first_rank, second_rank,
    {r6('seconds')} AS seconds, {r6('step_m')} AS step_m, {r6('speed_m_s')} AS speed_m_s FROM ({SPEED})""")
def pose_speed_events(v):
    out = ts.pose_speed_events(v.poses, POLICY.pose_speed_warning_m_s)
    return out.select("capture_id", "first_rank", "second_rank", *r6c("seconds", "step_m", "speed_m_s"))


@query("histogram_change", "frame_poses", sql=f"""
    SELECT capture_id, rank, {r6('list_sum(list_transform(list_zip(histogram, before), lambda p: abs(p[1] - p[2]))) / 2')} AS change
    FROM (SELECT *, lag(histogram) OVER (PARTITION BY capture_id ORDER BY rank) AS before FROM frame_poses)""")
def histogram_change(v):
    return ts.histogram_change(v.frame_poses).select("capture_id", "rank", *r6c("change"))


@query("stream_timing", "sensor_samples", "frames", sql=f"""
    SELECT capture_id, stream, samples, {r6('CAST(a - origin AS DOUBLE)')} AS relative_start_sec,
      {r6('CAST(b - origin AS DOUBLE)')} AS relative_end_sec, {r6('med')} AS median_interval_sec,
      {r6('CAST(top AS DOUBLE)')} AS maximum_interval_sec,
      {r6('CASE WHEN b > a THEN (samples - 1) / CAST(b - a AS DOUBLE) END')} AS effective_rate_hz
    FROM (SELECT capture_id, stream, count(*) AS samples, min(sensor_sec) AS a, max(sensor_sec) AS b,
            quantile_cont(CAST(step AS DOUBLE), 0.5) AS med, max(step) AS top
          FROM (SELECT *, sensor_sec - lag(sensor_sec) OVER (PARTITION BY capture_id, stream ORDER BY source_row) AS step
                FROM sensor_samples) GROUP BY ALL)
    JOIN (SELECT capture_id, min(sensor_sec) AS origin FROM frames GROUP BY ALL) USING (capture_id)""")
def stream_timing(v):
    out = ts.stream_timing(v.sensor_samples, ts.capture_origins(v.frames))
    return out.select("capture_id", "stream", "samples", *r6c(
        "relative_start_sec", "relative_end_sec", "median_interval_sec", "maximum_interval_sec", "effective_rate_hz"))


@query("boundary_coverage", "sensor_samples", "frames", sql="""
    SELECT capture_id, stream, CASE WHEN a > e OR b < s THEN 'NO_IMU_CAMERA_OVERLAP'
      WHEN a > s OR b < e THEN 'PARTIAL_IMU_BOUNDARY_COVERAGE' ELSE 'COVERED' END AS status
    FROM (SELECT capture_id, stream, min(sensor_sec) AS a, max(sensor_sec) AS b FROM sensor_samples GROUP BY ALL)
    JOIN (SELECT capture_id, min(sensor_sec) AS s, max(sensor_sec) AS e FROM frames GROUP BY ALL) USING (capture_id)""")
def boundary_coverage(v):
    return ts.boundary_coverage(v.sensor_samples, v.frames)


@query("state_counts", "frames", sql="SELECT capture_id, tracking_state, count(*) AS frames FROM frames GROUP BY ALL")
def state_counts(v):
    return ts.state_counts(v.frames)


@query("exposure_findings", "frames", sql="""
    SELECT capture_id, 'EXPOSURE_EXCEEDS_REQUESTED_CAP' AS code, 'WARNING' AS severity, count(*) AS frames,
      min(rank) AS first_rank FROM frames WHERE exposure_sec > 0.05 GROUP BY capture_id""")
def exposure_findings(v):
    return ts.exposure_findings(v.frames, F.lit(0.05))


@query("capture_findings", "frames", "annotations", sql=f"""
    WITH g AS (SELECT capture_id, count(*) FILTER (capture_id % 4 <> 0 AND exposure_sec > 0.05) AS n, min(rank) FILTER (capture_id % 4 <> 0 AND exposure_sec > 0.05) AS r FROM frames GROUP BY ALL),
      a AS (SELECT capture_id, count(*) AS objects FROM annotations GROUP BY ALL)
    SELECT capture_id, 'EXPOSURE_EXCEEDS_REQUESTED_CAP' AS code, 'WARNING' AS severity, 'observations_retained=true' AS details, n AS frames, r AS first_rank, CAST(0.05 AS DOUBLE) AS requested_cap, CAST(NULL AS BIGINT) AS objects FROM g WHERE n > 0
    UNION ALL SELECT capture_id, 'SCALE_PRIOR_NOT_LOCALIZED', 'WARNING', '{ts.UNSCALED}', NULL, NULL, NULL, objects FROM g JOIN a USING (capture_id)
    UNION ALL SELECT capture_id, 'PHYSICAL_CALIBRATION_UNVERIFIED', 'WARNING', '{ts.UNVERIFIED}', NULL, NULL, NULL, NULL FROM g""")
def capture_findings(v):
    settings = v.frames.select("capture_id", F.when(F.col("capture_id") % 4 != 0, 0.05).alias("requested_cap")).distinct()
    return ts.capture_findings(v.frames, settings, v.annotations)


@query("constant_clock_residual", "frames", "media_constant", sql=f"""
    WITH d AS (SELECT f.capture_id, f.rank AS rank, sensor_sec * 1000000 - ticks AS gap FROM frames f
               JOIN media_constant m ON f.capture_id = m.capture_id AND f.rank = m.decoded_rank),
         g AS (SELECT capture_id, count(*) AS n, arg_min(gap, rank) AS zero, min(gap) AS low, max(gap) AS high FROM d GROUP BY ALL)
    SELECT capture_id, n AS frame_rows, n AS decoded_rows, CAST(greatest(high - zero, zero - low) AS BIGINT) AS maximum_residual_ticks,
      {r3('CAST(zero AS DOUBLE) / 1000000')} AS origin_offset_sec,
      CASE WHEN greatest(high - zero, zero - low) > 2 THEN 'FRAME_CLOCK_MISMATCH' ELSE 'ASSOCIATED' END AS status FROM g""")
def constant_clock_residual(v):
    out = ts.constant_clock(v.frames, v.media_constant)
    return out.withColumn("origin_offset_sec", round3(F.col("origin_offset_sec")))


@query("affine_clock_fit", "frames", "media_affine", sql=f"""
    WITH p AS (SELECT f.capture_id, f.rank, sensor_sec, ticks FROM frames f JOIN media_affine m
               ON f.capture_id = m.capture_id AND f.rank = m.decoded_rank + 1),
      b AS (SELECT capture_id, arg_min(ticks, rank) AS t0, arg_min(sensor_sec, rank) AS s0 FROM p GROUP BY ALL),
      xy AS (SELECT capture_id, (ticks - t0) * CAST(0.000001 AS DOUBLE) AS x, CAST(sensor_sec - s0 AS DOUBLE) AS y
             FROM p JOIN b USING (capture_id)),
      fit AS (SELECT capture_id, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, count(*) AS matched FROM xy GROUP BY ALL),
      w AS (SELECT capture_id, max(abs(y - (intercept + slope * x))) AS worst FROM xy JOIN fit USING (capture_id) GROUP BY ALL)
    SELECT capture_id, n AS frame_rows, matched, {r6('slope')} AS slope, {r3('intercept')} AS intercept,
      {r3('worst')} AS maximum_residual_sec,
      CASE WHEN matched <> n - 1 THEN 'FRAME_COUNT_MISMATCH' WHEN matched < 3 THEN 'NONMONOTONIC_PTS'
        WHEN abs(slope - 1) <= 0.01 AND worst <= 0.01 THEN 'ASSOCIATED' ELSE 'FRAME_CLOCK_MISMATCH' END AS status
    FROM (SELECT capture_id, count(*) AS n FROM frames GROUP BY ALL) JOIN fit USING (capture_id) JOIN w USING (capture_id)""")
def affine_clock_fit(v):
    out = ts.affine_clock(v.frames, v.media_affine)
    return out.select("capture_id", "frame_rows", "matched", *r6c("slope"), round3(F.col("intercept")).alias("intercept"),
                      round3(F.col("maximum_residual_sec")).alias("maximum_residual_sec"), "status")


@query("unassociated_frames", "frames", sql="SELECT capture_id, rank FROM frames WHERE rank = 0")
def unassociated_frames(v):
    return ts.unassociated_frames(v.frames, v.media_affine)


@query("stage_durations", "stage_history", sql=f"""
    SELECT job_id, seq, stage, {r6('CAST(lead(started_sec) OVER (PARTITION BY job_id ORDER BY started_sec, seq) - started_sec AS DOUBLE)')} AS seconds
    FROM stage_history""")
def stage_durations(v):
    return ts.stage_durations(v.stage_history).select("job_id", "seq", "stage", *r6c("seconds"))


# --- intervals --------------------------------------------------------------

@query("annotation_window_frames", "frames", "annotations", sql="""
    SELECT capture_id, rank, count(*) AS objects,
      string_agg(lpad(CAST(object_id AS VARCHAR), 10, '0'), ';' ORDER BY object_id) AS object_ids
    FROM frames JOIN annotations USING (capture_id)
    WHERE CAST(relative_sec AS DOUBLE) BETWEEN start_sec AND end_sec GROUP BY capture_id, rank""")
def annotation_window_frames(v):
    return iv.annotation_windows(v.frames, v.annotations)


@query("unmatched_windows", "frames", "annotations", sql="""
    SELECT capture_id, object_id, 'INVALID_ANNOTATION' AS code FROM annotations a WHERE NOT EXISTS
      (SELECT 1 FROM frames f WHERE f.capture_id = a.capture_id AND CAST(f.relative_sec AS DOUBLE) BETWEEN start_sec AND end_sec)""")
def unmatched_windows(v):
    return iv.unmatched_windows(v.frames, v.annotations)


@query("sensor_interval_stats", "sensor_samples", "frames", sql=f"""
    WITH o AS (SELECT capture_id, min(sensor_sec) AS origin FROM frames GROUP BY ALL),
      s AS (SELECT capture_id, source_row, CAST(sensor_sec - origin AS DOUBLE) AS t, sqrt(x*x + y*y + z*z) AS mag
            FROM sensor_samples JOIN o USING (capture_id) WHERE stream = 'view'),
      i AS (SELECT capture_id, rank, greatest(CAST(relative_sec AS DOUBLE) - 20000, 0) AS a, CAST(relative_sec AS DOUBLE) + 20000 AS b FROM frames),
      reach AS (SELECT capture_id, min(t) AS lo, max(t) AS hi FROM s GROUP BY ALL),
      j AS (SELECT i.capture_id, i.rank, any_value(a) AS a, any_value(b) AS b, count(*) FILTER (t >= a AND t <= b) AS n,
              count(*) FILTER (t < a) AS below, min(t) FILTER (t >= a AND t <= b) AS f, max(t) FILTER (t >= a AND t <= b) AS l,
              sqrt(avg(mag*mag) FILTER (t >= a AND t <= b)) AS rms, max(mag) FILTER (t >= a AND t <= b) AS top
            FROM i LEFT JOIN s ON s.capture_id = i.capture_id GROUP BY i.capture_id, i.rank)
    SELECT capture_id, rank, n AS sample_count, below AS range_start, below + n AS range_end,
      coalesce(lo <= a AND b <= hi, false) AS boundary_covered, {r6('f')} AS first_sample_sec, {r6('l')} AS last_sample_sec,
      {r6('rms')} AS rms_magnitude, {r6('top')} AS maximum_magnitude FROM j LEFT JOIN reach USING (capture_id)""")
def sensor_interval_stats(v):
    out = gyro_motion(v, v.frames, 20000.0)
    return out.select("capture_id", "rank", "sample_count", "range_start", "range_end", "boundary_covered",
                      *r6c("first_sample_sec", "last_sample_sec", "rms_magnitude", "maximum_magnitude"))


def gyro_motion(v, frames, half):
    sec = F.col("relative_sec").cast("double")
    windows = frames.select("capture_id", "rank", F.greatest(sec - half, F.lit(0.0)).alias("start"), (sec + half).alias("end"))
    s = v.sensor_samples.where(F.col("stream") == "view").join(ts.capture_origins(v.frames), "capture_id")
    s = s.select("capture_id", "source_row", (F.col("sensor_sec") - F.col("origin_sec")).cast("double").alias("t"), "x", "y", "z")
    mag = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return iv.interval_stats(s, windows, ["capture_id"], ["rank"], mag)


# --- selection --------------------------------------------------------------

CANDIDATES = """SELECT *, tracking_state = 'normal' AS tracking_normal, CAST(k AS DOUBLE) * (1 + event_id % 9) AS laplacian_variance,
      k * 3 AS texture_corners, (event_id % 10) / CAST(40 AS DOUBLE) AS dark_fraction, (event_id % 7) / CAST(40 AS DOUBLE) AS bright_fraction FROM
    (SELECT *, max(bucket) OVER (PARTITION BY capture_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top,
       lead(rank) OVER (PARTITION BY capture_id ORDER BY rank) AS after_rank
     FROM (SELECT *, CAST(floor(CAST(relative_sec AS DOUBLE) * 0.0001 + 1e-8) AS BIGINT) AS bucket FROM frame_poses))
    WHERE bucket > coalesce(top, -1) OR after_rank IS NULL"""

SCORED = f"""SELECT *, 0.45 * least(1.0, ln(1 + laplacian_variance) / ln(1 + p90)) + 0.35 * least(1.0, texture_corners / CAST(150 AS DOUBLE))
      + 0.20 * (1 - least(1.0, dark_fraction + bright_fraction)) AS score FROM ({CANDIDATES})
    JOIN (SELECT capture_id, greatest(quantile_cont(laplacian_variance, 0.9), 1e-6) AS p90 FROM ({CANDIDATES}) GROUP BY ALL) USING (capture_id)"""


def candidates(v, *wide):
    """Downsampled frames with what scores need; other columns only as named, since every one is shuffled."""
    c = sel.bucket_downsample(v.poses.select("capture_id", "rank", "relative_sec", "tracking_state", "k", "event_id", *wide), POLICY)
    return stage(c.select("*", (F.col("tracking_state") == "normal").alias("tracking_normal"),
                    (F.col("k").cast("double") * (1 + F.col("event_id") % 9)).alias("laplacian_variance"),
                    (F.col("k") * 3).alias("texture_corners"), ((F.col("event_id") % 10) / 40).alias("dark_fraction"),
                    ((F.col("event_id") % 7) / 40).alias("bright_fraction")))


@query("bucket_downsample", "frame_poses", sql=f"SELECT capture_id, rank, bucket FROM ({CANDIDATES})")
def bucket_downsample(v):
    return sel.bucket_downsample(v.poses.select("capture_id", "rank", "relative_sec"), POLICY).select("capture_id", "rank", "bucket")


@query("session_quality_scores", "frame_poses", sql=f"""
    SELECT capture_id, rank, {r6('p90')} AS sharpness_reference_p90, {r6('score')} AS score FROM ({SCORED})""")
def session_quality_scores(v):
    return sel.quality_scores(candidates(v)).select("capture_id", "rank", *r6c("sharpness_reference_p90", "score"))


@query("quality_flags", "frame_poses", "sensor_samples", sql=f"""
    WITH c AS ({SCORED}), o AS (SELECT capture_id, min(sensor_sec) AS origin FROM frames GROUP BY ALL),
      s AS (SELECT capture_id, CAST(sensor_sec - origin AS DOUBLE) AS t, sqrt(x*x + y*y + z*z) AS mag
            FROM sensor_samples JOIN o USING (capture_id) WHERE stream = 'view'),
      m AS (SELECT c.capture_id, c.rank, max(mag) AS top FROM c JOIN s ON s.capture_id = c.capture_id
            AND t BETWEEN CAST(relative_sec AS DOUBLE) - 4500 AND CAST(relative_sec AS DOUBLE) + 4500 GROUP BY ALL),
      e AS ({SPEED})
    SELECT capture_id, rank, concat_ws(';', CASE WHEN NOT tracking_normal THEN 'NON_NORMAL_TRACKING' END,
      CASE WHEN m.top > 80 THEN 'FAST_DEVICE_ROTATION' END,
      CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.capture_id = c.capture_id AND c.rank BETWEEN e.first_rank AND e.second_rank) THEN 'POSE_SPEED_WARNING' END,
      CASE WHEN laplacian_variance < p90 * 0.15 THEN 'RELATIVELY_LOW_SHARPNESS' END,
      CASE WHEN texture_corners < 30 THEN 'LOW_TEXTURE' END,
      CASE WHEN dark_fraction + bright_fraction > 0.25 THEN 'CLIPPED_EXPOSURE' END) AS flags
    FROM c LEFT JOIN m USING (capture_id, rank)""")
def quality_flags(v):
    c = sel.quality_scores(candidates(v))
    motion = gyro_motion(v, c.select("capture_id", "rank", "relative_sec"), POLICY.gyro_half_window_seconds)
    hit = sel.event_overlap(c.select("capture_id", "rank"), ts.pose_speed_events(v.poses, POLICY.pose_speed_warning_m_s))
    c = c.join(motion.select("capture_id", "rank", "maximum_magnitude"), ["capture_id", "rank"], "left")
    c = c.join(hit.withColumn("in_speed_event", F.lit(True)), ["capture_id", "rank"], "left")
    return sel.quality_flags(c, POLICY).select("capture_id", "rank", F.array_join("flags", ";").alias("flags"))


@query("event_overlap_flags", "frame_poses", sql=f"""
    WITH c AS ({CANDIDATES}), e AS ({SPEED})
    SELECT capture_id, rank, 'POSE_SPEED_WARNING' AS reason FROM c WHERE EXISTS
      (SELECT 1 FROM e WHERE e.capture_id = c.capture_id AND c.rank BETWEEN e.first_rank AND e.second_rank)
    UNION ALL SELECT capture_id, rank, 'POSE_EVENT_CONTEXT' FROM c WHERE EXISTS
      (SELECT 1 FROM e WHERE e.capture_id = c.capture_id AND abs(CAST(c.relative_sec AS DOUBLE) - e.seconds) <= 18000)""")
def event_overlap_flags(v):
    c, e = candidates(v), ts.pose_speed_events(v.poses, POLICY.pose_speed_warning_m_s)
    inside = sel.event_overlap(c, e).select("capture_id", "rank", F.lit("POSE_SPEED_WARNING").alias("reason"))
    return inside.unionByName(sel.event_context(c, e, POLICY))


COVERED = f"""SELECT capture_id, rank, 'TEMPORAL_COVERAGE' AS reason FROM (SELECT capture_id, rank, row_number() OVER (
        PARTITION BY capture_id, floor(CAST(relative_sec AS DOUBLE) / 100000) ORDER BY tracking_normal DESC, score DESC, rank) AS pos FROM ({SCORED})) WHERE pos = 1
    UNION ALL SELECT capture_id, max(rank), 'END_BOUNDARY' FROM ({CANDIDATES}) GROUP BY capture_id
    UNION ALL SELECT capture_id, min(rank), 'START_BOUNDARY' FROM ({CANDIDATES}) GROUP BY capture_id HAVING min(rank) < max(rank)"""


@query("best_per_bin", "frame_poses", sql=COVERED)
def best_per_bin(v):
    return sel.coverage_views(sel.quality_scores(candidates(v)), POLICY)


_MOVE = "sqrt((c.px-s.px)*(c.px-s.px) + (c.py-s.py)*(c.py-s.py) + (c.pz-s.pz)*(c.pz-s.pz))"
_TRACE = " + ".join(f"s.w{k}{i}*c.w{k}{i}" for i in range(3) for k in range(3))
_TURN = f"degrees(acos(greatest(-1.0, least(1.0, ({_TRACE} - 1) / 2))))"
_STATE = "tracking_normal, px, py, pz, " + ", ".join(f"w{i}{j}" for i in range(3) for j in range(3))
_PICK = ", ".join(f"CASE WHEN hit THEN c_{n} ELSE s_{n} END AS {n}" for n in _STATE.split(", "))
_BOTH = ", ".join(f"s.{n} AS s_{n}, c.{n} AS c_{n}" for n in _STATE.split(", "))
ANCHORS = f"""WITH RECURSIVE cov AS ({COVERED}),
      c AS MATERIALIZED (SELECT capture_id, rank, {_STATE}, row_number() OVER (PARTITION BY capture_id ORDER BY rank) AS pos,
             EXISTS (SELECT 1 FROM cov WHERE cov.capture_id = q.capture_id AND cov.rank = q.rank) AS kept FROM ({CANDIDATES}) q),
      walk AS (SELECT capture_id, rank, pos, false AS moved, false AS turned, false AS changed, {_STATE} FROM c WHERE pos = 1
        UNION ALL SELECT capture_id, rank, pos, moved, turned, changed, {_PICK} FROM
          (SELECT *, moved OR turned OR changed OR kept AS hit FROM
            (SELECT c.capture_id, c.rank, c.pos, c.kept, {_MOVE} >= 0.30 AS moved, {_TURN} >= 60 AS turned,
               c.tracking_normal <> s.tracking_normal AS changed, {_BOTH}
             FROM walk s JOIN c ON c.capture_id = s.capture_id AND c.pos = s.pos + 1)))
    SELECT capture_id, rank, 'TRANSLATION' AS reason FROM walk WHERE moved
    UNION ALL SELECT capture_id, rank, 'ROTATION' FROM walk WHERE turned
    UNION ALL SELECT capture_id, rank, 'TRACKING_TRANSITION' FROM walk WHERE changed"""


@query("anchor_scan", "frame_poses", sql=ANCHORS)
def anchor_scan(v):
    c = stage(sel.quality_scores(candidates(v, "px", "py", "pz", *ts.POSE)))
    return sel.anchor_scan(c, sel.coverage_views(c, POLICY), POLICY)


def chosen(v):
    """The candidates and the views that each rule but the recovery pass selects."""
    c = stage(sel.quality_scores(candidates(v, "px", "py", "pz", *ts.POSE)))
    covered = sel.coverage_views(c, POLICY)
    events = ts.pose_speed_events(v.poses, POLICY.pose_speed_warning_m_s)
    return c, covered, sel.anchor_scan(c, covered, POLICY), sel.event_context(c, events, POLICY)


def links(c, kept):
    """Adjacent views of `kept` with inlier counts taken from the second view."""
    timed = c.join(kept, ["capture_id", "rank"], "left_semi")
    pairs = sel.adjacent_pairs(timed.select("capture_id", "rank", "relative_sec"))
    second = c.select("capture_id", F.col("rank").alias("second_rank"), F.col("k").alias("ratio_matches"),
                      (F.col("k") - F.col("event_id") % 40).alias("fundamental_inliers"),
                      (F.col("event_id") % 60).alias("homography_inliers"))
    return sel.link_status(pairs.join(second, ["capture_id", "second_rank"]), POLICY)


def linked_pairs(v):
    """Links between adjacent bin winners."""
    c = candidates(v)
    kept = stage(sel.coverage_views(sel.quality_scores(c), POLICY).select("capture_id", "rank").distinct())
    return c, kept, links(c, kept)


def links_sql(kept):
    return f"""SELECT capture_id, first_rank, second_rank, gap AS time_gap_sec, CASE WHEN greatest(k - event_id % 40, event_id % 60) >= 20
      AND greatest(k - event_id % 40, event_id % 60) / CAST(greatest(1, k) AS DOUBLE) >= 0.35 THEN 'SUPPORTED' ELSE 'WEAK' END AS visual_link FROM
    (SELECT capture_id, rank AS second_rank, lag(rank) OVER w AS first_rank, k, event_id,
       CAST(relative_sec - lag(relative_sec) OVER w AS DOUBLE) AS gap FROM ({CANDIDATES}) q
     WHERE EXISTS (SELECT 1 FROM ({kept}) v WHERE v.capture_id = q.capture_id AND v.rank = q.rank)
     WINDOW w AS (PARTITION BY capture_id ORDER BY rank)) WHERE first_rank IS NOT NULL"""


LINKS = links_sql(COVERED)

SELECTED = f"""WITH s AS MATERIALIZED ({COVERED} UNION ALL SELECT * FROM ({ANCHORS}) UNION ALL
      SELECT capture_id, rank, 'POSE_EVENT_CONTEXT' FROM ({CANDIDATES}) c WHERE EXISTS (SELECT 1 FROM ({SPEED}) e
        WHERE e.capture_id = c.capture_id AND abs(CAST(c.relative_sec AS DOUBLE) - e.seconds) <= 18000)),
      l AS ({links_sql('SELECT DISTINCT capture_id, rank FROM s')}),
      r AS (SELECT c.capture_id, c.rank, 'WEAK_LINK_RECOVERY' AS reason FROM ({CANDIDATES}) c JOIN l
        ON c.capture_id = l.capture_id AND c.rank > l.first_rank AND c.rank < l.second_rank WHERE visual_link = 'WEAK')
    SELECT capture_id, rank, string_agg(DISTINCT reason, ';' ORDER BY reason) AS reasons FROM (SELECT * FROM s UNION ALL SELECT * FROM r) GROUP BY capture_id, rank"""


@query("selected_views", "frame_poses", sql=SELECTED)
def selected_views(v):
    c, covered, anchors, context = chosen(v)
    rules = stage(covered.unionByName(anchors).unionByName(context).select("capture_id", "rank", "reason").distinct())
    kept = rules.select("capture_id", "rank").distinct()
    weak = links(c, kept).where("visual_link = 'WEAK'")
    return sel.selected_views(rules, sel.weak_link_recovery(c, kept, weak))


@query("weak_link_recovery", "frame_poses", sql=f"""
    SELECT c.capture_id, c.rank, 'WEAK_LINK_RECOVERY' AS reason FROM ({CANDIDATES}) c JOIN ({LINKS}) l
      ON c.capture_id = l.capture_id AND c.rank > l.first_rank AND c.rank < l.second_rank WHERE visual_link = 'WEAK'""")
def weak_link_recovery(v):
    c, kept, pairs = linked_pairs(v)
    return sel.weak_link_recovery(c, kept, pairs.where("visual_link = 'WEAK'"))


@query("gap_components", "frame_poses", sql=f"""
    SELECT capture_id, component, count(*) AS links, min(first_rank) AS first_rank, max(second_rank) AS last_rank FROM
      (SELECT *, CAST(sum(CASE visual_link WHEN 'WEAK' THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id ORDER BY first_rank) AS BIGINT) AS component
       FROM ({LINKS})) GROUP BY capture_id, component""")
def gap_components(v):
    return sel.gap_components(linked_pairs(v)[2])


@query("preparation_report", "frame_poses", sql=f"""
    WITH l AS ({LINKS}), p AS (SELECT capture_id, rank, px, py, pz FROM frame_poses),
      t AS (SELECT l.*, sqrt((a.px-b.px)*(a.px-b.px)+(a.py-b.py)*(a.py-b.py)+(a.pz-b.pz)*(a.pz-b.pz)) AS move FROM l
            JOIN p a ON a.capture_id = l.capture_id AND a.rank = first_rank JOIN p b ON b.capture_id = l.capture_id AND b.rank = second_rank),
      g AS (SELECT capture_id, count(*) AS n, count(*) FILTER (visual_link = 'SUPPORTED') AS sup, count(*) FILTER (visual_link = 'WEAK') AS weak,
              count(*) FILTER (time_gap_sec > 200000) AS gaps, count(*) FILTER (move < 0.02) AS low, max(time_gap_sec) AS top FROM t GROUP BY ALL),
      f AS (SELECT capture_id, count(*) AS frames, count(*) FILTER (tracking_state <> 'normal') AS limited FROM frame_poses GROUP BY ALL),
      c AS (SELECT capture_id, count(*) AS n FROM ({CANDIDATES}) GROUP BY ALL),
      s AS (SELECT capture_id, count(DISTINCT rank) AS n FROM ({COVERED}) GROUP BY ALL),
      e AS (SELECT capture_id, count(*) AS n FROM ({SPEED}) GROUP BY ALL)
    SELECT f.capture_id, frames AS source_frames, limited AS limited_frames, coalesce(c.n, 0) AS candidates, coalesce(s.n, 0) AS selected,
      coalesce(sup, 0) AS supported_links, coalesce(weak, 0) AS weak_links, coalesce(gaps, 0) AS temporal_gaps, coalesce(low, 0) AS low_baseline_links,
      coalesce(e.n, 0) AS speed_events, coalesce(weak, 0) + 1 AS temporal_components, {r6('coalesce(top, 0)')} AS maximum_gap_sec,
      CASE WHEN coalesce(weak, 0) > 0 OR coalesce(e.n, 0) > 0 OR coalesce(gaps, 0) > 0 OR coalesce(low / CAST(g.n AS DOUBLE) > 0.8, false)
        THEN 'REVIEW_REQUIRED' ELSE 'READY_FOR_RECONSTRUCTION_TRIAL' END AS readiness
    FROM f LEFT JOIN c USING (capture_id) LEFT JOIN s USING (capture_id) LEFT JOIN g USING (capture_id) LEFT JOIN e USING (capture_id)""")
def preparation_report(v):
    c, kept, pairs = linked_pairs(v)
    at = v.poses.select("capture_id", "rank", "px", "py", "pz")
    a = at.select("capture_id", F.col("rank").alias("first_rank"), *[F.col(x).alias(f"a{x}") for x in ("px", "py", "pz")])
    b = at.select("capture_id", F.col("rank").alias("second_rank"), *[F.col(x).alias(f"b{x}") for x in ("px", "py", "pz")])
    move = F.sqrt(sum((F.col(f"a{x}") - F.col(f"b{x}")) ** 2 for x in ("px", "py", "pz")))
    pairs = pairs.join(a, ["capture_id", "first_rank"]).join(b, ["capture_id", "second_rank"]).withColumn("translation_m", move)
    out = sel.preparation_report(v.frames, c, kept, pairs, ts.pose_speed_events(v.poses, POLICY.pose_speed_warning_m_s), POLICY)
    return out.withColumn("maximum_gap_sec", round6(F.col("maximum_gap_sec")))
