"""Candidate sampling, quality scores and view selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capstrata.functions import geometry as G
from capstrata.operators.intervals import interval_join
from capstrata.operators.ordered import quantiles, sequence_over
from capstrata.operators.timeseries import POSE
from capstrata.policies import SelectionPolicy


def bucket_downsample(frames: DataFrame, policy: SelectionPolicy) -> DataFrame:
    """First frame of each time bucket above all buckets so far, and the last frame."""
    sec = F.col("relative_sec").cast("double")
    placed = frames.withColumn("bucket", F.floor(sec * policy.candidate_fps + 1e-8))
    seq = sequence_over(placed, ["capture_id"], ["rank"], lead={"_after": "rank"},
                        running_max_before={"_top": F.col("bucket")})
    return seq.where((F.col("bucket") > F.coalesce("_top", F.lit(-1))) | F.col("_after").isNull()).drop("_top", "_after")


def limit_violations(frames: DataFrame, candidates: DataFrame, policy: SelectionPolicy) -> DataFrame:
    """Captures over the frame or candidate limit, which preparation refuses."""
    f = frames.groupBy("capture_id").agg(F.count("*").alias("n")).where(F.col("n") > policy.max_frames)
    c = candidates.groupBy("capture_id").agg(F.count("*").alias("n")).where(F.col("n") > policy.max_candidates)
    return f.select("capture_id", F.lit("PREPROCESS_FRAME_LIMIT").alias("code"), "n").unionByName(
        c.select("capture_id", F.lit("PREPROCESS_CANDIDATE_LIMIT").alias("code"), "n"))


def quality_scores(candidates: DataFrame) -> DataFrame:
    """Sharpness against the capture's 90th percentile, texture and exposure in one score.

    Needs ``laplacian_variance``, ``texture_corners``, ``dark_fraction`` and ``bright_fraction``.
    """
    ref = quantiles(candidates, ["capture_id"], "laplacian_variance", {"_p90": 0.9}).select(
        "capture_id", F.greatest("_p90", F.lit(1e-6)).alias("sharpness_reference_p90"))
    c = candidates.join(ref, "capture_id")
    sharp = F.least(F.lit(1.0), F.log1p("laplacian_variance") / F.log1p("sharpness_reference_p90"))
    texture = F.least(F.lit(1.0), F.col("texture_corners") / 150)
    exposure = 1 - F.least(F.lit(1.0), F.col("dark_fraction") + F.col("bright_fraction"))
    return c.withColumn("score", 0.45 * sharp + 0.35 * texture + 0.20 * exposure)


def quality_flags(scored: DataFrame, policy: SelectionPolicy) -> DataFrame:
    """Flags per candidate. Observations stay; only reasons are added.

    Uses ``tracking_normal`` and, where present, ``maximum_magnitude`` of the gyroscope
    and ``in_speed_event``.
    """
    has = set(scored.columns)
    flag = lambda cond, name: F.when(cond, F.lit(name))
    rules = [flag(~F.col("tracking_normal"), "NON_NORMAL_TRACKING")]
    if "maximum_magnitude" in has:
        rules.append(flag(F.col("maximum_magnitude") > policy.gyro_warning_rad_s, "FAST_DEVICE_ROTATION"))
    if "in_speed_event" in has:
        rules.append(flag(F.col("in_speed_event"), "POSE_SPEED_WARNING"))
    rules += [
        flag(F.col("laplacian_variance") < F.col("sharpness_reference_p90") * 0.15, "RELATIVELY_LOW_SHARPNESS"),
        flag(F.col("texture_corners") < 30, "LOW_TEXTURE"),
        flag(F.col("dark_fraction") + F.col("bright_fraction") > 0.25, "CLIPPED_EXPOSURE")]
    return scored.withColumn("flags", F.array_compact(F.array(*rules)))


def event_overlap(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """Candidates whose rank lies inside a speed event."""
    touched = events.select("capture_id", F.explode(F.sequence("first_rank", "second_rank")).alias("rank")).distinct()
    return candidates.join(touched, ["capture_id", "rank"], "left_semi")


def event_context(candidates: DataFrame, events: DataFrame, policy: SelectionPolicy) -> DataFrame:
    """Candidates near an event in time, kept for review."""
    half = policy.event_context_seconds
    near = events.select("capture_id", (F.col("seconds") - half).alias("_a"), (F.col("seconds") + half).alias("_b"))
    timed = candidates.select("capture_id", "rank", F.col("relative_sec").cast("double").alias("_t"))
    return interval_join(timed, near, ["capture_id"], "_t", "_a", "_b", 2 * half, "left_semi").select(
        "capture_id", "rank", F.lit("POSE_EVENT_CONTEXT").alias("reason"))


def coverage_views(candidates: DataFrame, policy: SelectionPolicy) -> DataFrame:
    """Both ends of a capture and the best candidate of every coverage bin, with reasons."""
    bin_ = F.floor(F.col("relative_sec").cast("double") / (policy.max_gap_seconds / 2))
    best = candidates.groupBy("capture_id", bin_.alias("_bin")).agg(
        F.max(F.struct("tracking_normal", "score", (-F.col("rank")).alias("_r"))).alias("_b")).select(
        "capture_id", (-F.col("_b._r")).alias("rank"), F.lit("TEMPORAL_COVERAGE").alias("reason"))
    ends = candidates.groupBy("capture_id").agg(F.min("rank").alias("_s"), F.max("rank").alias("_e"))
    start = ends.select("capture_id", F.col("_s").alias("rank"), F.lit("START_BOUNDARY").alias("reason"))
    # a single candidate is recorded under its last boundary only
    end = ends.select("capture_id", F.col("_e").alias("rank"), F.lit("END_BOUNDARY").alias("reason"))
    start = start.join(ends.where("_s = _e").select("capture_id"), "capture_id", "left_anti")
    return start.unionByName(end).unionByName(best)


def anchor_scan(candidates: DataFrame, covered: DataFrame, policy: SelectionPolicy) -> DataFrame:
    """Candidates that moved, turned or changed tracking since the last kept one.

    A row kept by the coverage rule always becomes the anchor, whatever came before. The
    scan therefore falls apart into short stretches between coverage rows, each with a
    known first anchor. A stretch spans at most two coverage bins, so folding it inside
    one row is bounded by the candidate rate, and a long capture runs in parallel.
    """
    marks = covered.select("capture_id", "rank").distinct().withColumn("_kept", F.lit(True))
    c = candidates.select("capture_id", "rank", "tracking_normal", "px", "py", "pz", *POSE)
    c = c.join(marks, ["capture_id", "rank"], "left")
    seq = sequence_over(c, ["capture_id"], ["rank"],
                        running_max_before={"_anchor": F.when(F.col("_kept"), F.col("rank"))})
    state = ["tracking_normal", "px", "py", "pz", *POSE]
    anchors = c.where(F.col("_kept")).select("capture_id", F.col("rank").alias("_anchor"), F.struct(*state).alias("_from"))
    step = F.struct("rank", F.coalesce("_kept", F.lit(False)).alias("kept"), *state)
    stretches = seq.where(F.col("_anchor").isNotNull()).groupBy("capture_id", "_anchor").agg(
        F.array_sort(F.collect_list(step)).alias("_rows")).join(anchors, ["capture_id", "_anchor"])

    def place(s):
        return ([s["px"], s["py"], s["pz"]], [[s[f"w{i}{j}"] for j in range(3)] for i in range(3)])

    def fold(acc, row):
        (ta, ra), (tb, rb) = place(acc["from"]), place(row)
        distance, angle = G.pose_delta(ta, ra, tb, rb)
        reasons = F.array_compact(F.array(
            F.when(distance >= policy.translation_m, F.lit("TRANSLATION")),
            F.when(angle >= policy.rotation_degrees, F.lit("ROTATION")),
            F.when(row["tracking_normal"] != acc["from"]["tracking_normal"], F.lit("TRACKING_TRANSITION"))))
        moved = F.size(reasons) > 0
        here = F.struct(*[row[k].alias(k) for k in state])
        found = F.when(moved, F.concat(acc["out"], F.array(F.struct(row["rank"].alias("rank"), reasons.alias("reasons"))))
                       ).otherwise(acc["out"])
        return F.struct(F.when(moved | row["kept"], here).otherwise(acc["from"]).alias("from"), found.alias("out"))

    empty = F.from_json(F.lit("[]"), "array<struct<rank:bigint,reasons:array<string>>>")
    folded = F.aggregate("_rows", F.struct(F.col("_from").alias("from"), empty.alias("out")), fold, lambda a: a["out"])
    return stretches.select("capture_id", F.explode(folded).alias("_k")).select(
        "capture_id", F.col("_k.rank").alias("rank"), F.explode("_k.reasons").alias("reason"))


def weak_link_recovery(candidates: DataFrame, selected: DataFrame, weak_pairs: DataFrame) -> DataFrame:
    """All candidates strictly between the two views of a weak link.

    Adjacent selected views cut the candidates into stretches, so each candidate looks up
    the selected view before it and needs no range join.
    """
    marks = selected.select("capture_id", "rank").distinct().withColumn("_sel", F.lit(True))
    c = candidates.select("capture_id", "rank").join(marks, ["capture_id", "rank"], "left")
    seq = sequence_over(c, ["capture_id"], ["rank"],
                        running_max_before={"first_rank": F.when(F.col("_sel"), F.col("rank"))})
    between = seq.where(F.col("_sel").isNull() & F.col("first_rank").isNotNull())
    return between.join(weak_pairs.select("capture_id", "first_rank"), ["capture_id", "first_rank"], "left_semi").select(
        "capture_id", "rank", F.lit("WEAK_LINK_RECOVERY").alias("reason"))


def adjacent_pairs(selected: DataFrame) -> DataFrame:
    """Each selected view with the next one of its capture."""
    seq = sequence_over(selected, ["capture_id"], ["rank"], lead={"second_rank": "rank", "second_sec": "relative_sec"})
    return seq.where(F.col("second_rank").isNotNull()).select(
        "capture_id", F.col("rank").alias("first_rank"), "second_rank",
        (F.col("second_sec") - F.col("relative_sec")).cast("double").alias("time_gap_sec"))


def link_status(pairs: DataFrame, policy: SelectionPolicy) -> DataFrame:
    """SUPPORTED or WEAK from the counted inliers of a pair."""
    support = F.greatest("fundamental_inliers", "homography_inliers")
    good = (support >= policy.min_matches) & (
        support / F.greatest(F.lit(1), F.col("ratio_matches")) >= policy.min_inlier_ratio)
    return pairs.withColumn("visual_link", F.when(good, "SUPPORTED").otherwise("WEAK"))


def gap_components(pairs: DataFrame) -> DataFrame:
    """Runs of views between weak links; a capture has weak links + 1 of them."""
    seq = sequence_over(pairs, ["capture_id"], ["first_rank"],
                        running_sum={"component": F.when(F.col("visual_link") == "WEAK", 1).otherwise(0)})
    return seq.groupBy("capture_id", "component").agg(
        F.count("*").alias("links"), F.min("first_rank").alias("first_rank"), F.max("second_rank").alias("last_rank"))


def selected_views(*reasons: DataFrame) -> DataFrame:
    """Union of the selection rules with sorted distinct reasons per view."""
    rows = reasons[0].select("capture_id", "rank", "reason")
    for r in reasons[1:]:
        rows = rows.unionByName(r.select("capture_id", "rank", "reason"))
    return rows.distinct().groupBy("capture_id", "rank").agg(
        F.array_join(F.array_sort(F.collect_list("reason")), ";").alias("reasons"))


def preparation_report(frames: DataFrame, candidates: DataFrame, selected: DataFrame, pairs: DataFrame,
                       events: DataFrame, policy: SelectionPolicy) -> DataFrame:
    """Counts, weak links, gaps, baseline share and readiness of each capture."""
    k = "capture_id"
    count = lambda df, name: df.groupBy(k).agg(F.count("*").alias(name))
    links = pairs.groupBy(k).agg(
        F.count_if(F.col("visual_link") == "SUPPORTED").alias("supported_links"),
        F.count_if(F.col("visual_link") == "WEAK").alias("weak_links"),
        F.count_if(F.col("time_gap_sec") > policy.max_gap_seconds).alias("temporal_gaps"),
        F.count_if(F.col("translation_m") < 0.02).alias("low_baseline_links"),
        F.max("time_gap_sec").alias("maximum_gap_sec"), F.count("*").alias("_links"))
    limited = frames.groupBy(k).agg(F.count("*").alias("source_frames"),
                                    F.count_if(F.col("tracking_state") != "normal").alias("limited_frames"))
    out = limited.join(count(candidates, "candidates"), k, "left").join(count(selected, "selected"), k, "left")
    out = out.join(links, k, "left").join(count(events, "speed_events"), k, "left")
    zero = ["candidates", "selected", "supported_links", "weak_links", "temporal_gaps", "low_baseline_links", "speed_events"]
    out = out.fillna(0, zero)
    low = F.coalesce(F.col("low_baseline_links") / F.col("_links") > 0.8, F.lit(False))
    review = (F.col("weak_links") > 0) | (F.col("speed_events") > 0) | (F.col("temporal_gaps") > 0) | low
    return out.select(k, "source_frames", "limited_frames", *zero, (F.col("weak_links") + 1).alias("temporal_components"),
                      F.coalesce("maximum_gap_sec", F.lit(0.0)).alias("maximum_gap_sec"),
                      F.when(review, "REVIEW_REQUIRED").otherwise("READY_FOR_RECONSTRUCTION_TRIAL").alias("readiness"))
