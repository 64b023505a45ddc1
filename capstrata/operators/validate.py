"""Row contracts of frames, calibrations, poses and annotations; violations only, never repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capstrata.operators.intervals import unmatched_windows


def _codes(*rules):
    return F.explode(F.array_distinct(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in rules]))))


def camera_row_violations(rows: DataFrame, media: DataFrame) -> DataFrame:
    """Image grid, focal lengths, principal point, exposure and tracking state of every camera row."""
    m = media.select("capture_id", F.col("width").alias("_w"), F.col("height").alias("_h"))
    j = rows.join(m, "capture_id", "left")
    grid = ~(F.col("width").eqNullSafe(F.col("_w")) & F.col("height").eqNullSafe(F.col("_h")))
    lens = ~F.coalesce((F.col("fx") > 0) & (F.col("fy") > 0) & (F.col("cx") >= 0) & (F.col("cx") < F.col("_w"))
                       & (F.col("cy") >= 0) & (F.col("cy") < F.col("_h")), F.lit(False))
    return j.select("capture_id", "rank", _codes(
        (grid, "CALIBRATION_GRID_MISMATCH"), (lens, "INVALID_INTRINSICS"), (F.col("exposure_sec") <= 0, "INVALID_EXPOSURE"),
        (F.coalesce("tracking_state", F.lit("")) == "", "MISSING_TRACKING_STATE")).alias("code"))


def matrix_violations(matrices: DataFrame, rows: DataFrame) -> DataFrame:
    """The legacy camera matrix must equal the last per-frame calibration."""
    k = ["fx", "fy", "cx", "cy"]
    last = rows.groupBy("capture_id").agg(F.max_by(F.struct(*k), "rank").alias("_k"))
    same = F.lit(True)
    for c in k:
        same = same & F.col(c).eqNullSafe(F.col(f"_k.{c}"))
    return matrices.join(last, "capture_id", "left").where(~same).select("capture_id", F.lit("CALIBRATION_MISMATCH").alias("code"))


def associated_frames(frames: DataFrame, calibration: DataFrame, poses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames with their calibration and pose, and the captures where the three are not one to one."""
    k = ["capture_id", "frame_id"]
    joined = frames.join(calibration, k).join(poses, k)
    count = lambda df, n: df.groupBy("capture_id").agg(F.count("*").alias(n))
    n = count(frames, "_f").join(count(calibration, "_c"), "capture_id", "full_outer").join(count(poses, "_p"), "capture_id", "full_outer").join(
        count(joined, "_j"), "capture_id", "left")
    ok = F.coalesce((F.col("_f") == F.col("_c")) & (F.col("_f") == F.col("_p")) & (F.col("_f") == F.col("_j")), F.lit(False))
    return joined, n.where(~ok).select("capture_id", F.lit("PREPROCESS_ASSOCIATION_FAILED").alias("code"))


def bind_assets(observations: DataFrame, depth: DataFrame, confidence: DataFrame, rgb: DataFrame) -> DataFrame:
    """Depth, confidence and RGB asset of each observation by frame id; confidence may be absent."""
    k = ["capture_id", "frame"]
    pick = lambda df, n: df.select(*k, F.col("asset_id").alias(n))
    return (observations.join(pick(depth, "depth_asset_id"), k, "left").join(pick(confidence, "confidence_asset_id"), k, "left")
            .join(rgb.select("capture_id", F.col("asset_id").alias("rgb_asset_id")), "capture_id", "left"))


def annotation_violations(annotations: DataFrame, frames: DataFrame, videos: DataFrame) -> DataFrame:
    """Declarations bound to another video, repeated ids, bad sizes or windows, windows without frames."""
    v = videos.select("capture_id", F.col("sha256").alias("_v"))
    uses = annotations.groupBy("capture_id", "object_id").agg(F.count("*").alias("_n"))
    j = annotations.join(v, "capture_id", "left").join(uses, ["capture_id", "object_id"])
    window = ~F.coalesce((F.col("start_sec") >= 0) & (F.col("start_sec") < F.col("end_sec")), F.lit(False))
    rows = j.select("capture_id", "object_id", _codes(
        (~F.col("source_video_sha256").eqNullSafe(F.col("_v")), "ANNOTATION_SOURCE_MISMATCH"),
        ((F.col("_n") > 1) | ~((F.col("width_m") > 0) & (F.col("height_m") > 0)) | window, "INVALID_ANNOTATION")).alias("code"))
    sound = annotations.where(~window)
    return rows.unionByName(unmatched_windows(frames, sound)).distinct()
