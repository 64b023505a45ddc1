"""Strict file scans: fixed headers, explicit schemas, original line numbers, content hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capstrata.functions import text as X
from capstrata.functions.numeric import exact_number

# Export headers of the supported capture layouts.
POSE_HEADER = ["frame_index", "record_slot", "sensor_sec", "utc_sec", "tx_m", "ty_m", "tz_m", "qw", "qx", "qy", "qz",
               "exposure_sec", "tracking_state", "fx_px", "fy_px", "cx_px", "cy_px", "width_px", "height_px"]
STREAM_HEADERS = {
    "accelerometer": ["sensor_sec", "utc_sec", "ax_m_s2", "ay_m_s2", "az_m_s2"],
    "gyroscope": ["sensor_sec", "utc_sec", "gx_rad_s", "gy_rad_s", "gz_rad_s"],
    "magnetometer": ["sensor_sec", "utc_sec", "mx_uT", "my_uT", "mz_uT"],
    "device_motion": ["sensor_sec", "utc_sec", "qw", "qx", "qy", "qz", "roll", "pitch", "yaw", "gravity_x_m_s2",
                      "gravity_y_m_s2", "gravity_z_m_s2", "user_accel_x_m_s2", "user_accel_y_m_s2",
                      "user_accel_z_m_s2", "rotation_rate_x_rad_s", "rotation_rate_y_rad_s", "rotation_rate_z_rad_s",
                      "magnetic_field_x_uT", "magnetic_field_y_uT", "magnetic_field_z_uT", "magnetic_accuracy",
                      "heading_deg"],
    "imu": ["sensor_sec", "utc_sec", "ax_m_s2", "ay_m_s2", "az_m_s2", "gx_rad_s", "gy_rad_s", "gz_rad_s",
            "accel_sensor_sec", "gyro_sensor_sec"],
}
ODOMETRY_HEADER = ["timestamp", "frame", "x", "y", "z", "qx", "qy", "qz", "qw", "fx", "fy", "cx", "cy",
                   "distortion_center_x", "distortion_center_y"]
NATIVE_IMU_HEADER = ["timestamp", "a_x", "a_y", "a_z", "alpha_x", "alpha_y", "alpha_z"]
# Asset role by exact path, and by folder.
ROLES = {"wide.mp4": "rgb", "meta.json": "metadata", "arkit_pose.csv": "pose_calibration", "accelerometer.csv": "accelerometer",
         "gyroscope.csv": "gyroscope", "magnetometer.csv": "magnetometer", "device_motion.csv": "device_motion", "imu.csv": "imu"}
NATIVE_ROLES = {"rgb.mp4": "rgb", "odometry.csv": "pose_calibration", "camera_matrix.csv": "pose_calibration", "imu.csv": "imu_native"}
DEPTH_FOLDERS = ["depth/", "confidence/", "lidar_depth/"]


def _lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Every line of every file with its 1-based number, and the files that have lines.

    Spark cuts files into byte ranges, each read by a task of its own; a line belongs to the range it starts in. A range
    leaves its count of lines, the counts before it are summed per file, and a line's number is that sum and its place in
    the range. A leading byte-order mark is dropped.
    """
    source = spark.read.option("recursiveFileLookup", True)
    text = source.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_range"),
                                    F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    ranges = text.groupBy("file", "_range").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("file", "_range", (F.coalesce(before, F.lit(0)) + 1 - F.col("_first")).alias("_shift"))
    numbered = text.join(ranges, ["file", "_range"]).withColumn("source_line", F.col("_id") + F.col("_shift"))
    line = F.when(F.col("source_line") == 1, F.regexp_replace("line", "^\ufeff", "")).otherwise(F.col("line"))
    return numbered.select("file", "source_line", line.alias("line")), ranges.select("file").distinct()


def scan_csv(spark: SparkSession, path: str, header: list[str], *, comments: bool, optional: tuple[str, ...] = (),
             text_columns: tuple[str, ...] = ("tracking_state",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, comment lines and violations of CSV files with exactly this header.

    Values stay strings as written, trimmed. A wrong header, a ragged row, an empty stream
    or a value that is no finite number becomes a violation row; no row is repaired.
    """
    lines, every = _lines(spark, path)
    mark = F.ltrim(F.col("line")).startswith("#") if comments else F.lit(False)
    notes = lines.where(mark).select("file", "source_line", F.col("line").alias("text"))
    body = lines.where(~mark & (F.trim("line") != ""))
    heads = body.groupBy("file").agg(F.min_by("line", "source_line").alias("_head"), F.min("source_line").alias("_at"), F.count("*").alias("_n"))
    files = every.join(heads, "file", "left")
    cells = F.transform(F.split(F.col("_head"), ","), lambda c: F.trim(c))
    good = files.where(cells == F.array(*[F.lit(h) for h in header]))
    code = F.when(F.col("_head").isNull() | (F.col("_n") < 2), "EMPTY_STREAM").when(
        cells != F.array(*[F.lit(h) for h in header]), "UNSUPPORTED_HEADER")
    bad_files = files.select("file", F.lit(None).cast("bigint").alias("source_line"), code.alias("code")).where("code IS NOT NULL")
    rows = body.join(good.select("file", "_at"), "file").where("source_line > _at").drop("_at")
    width = F.size(F.split("line", ',(?=(?:[^"]*"[^"]*")*[^"]*$)'))
    rows = rows.withColumn("_ok", width == len(header))
    schema = ", ".join(f"`{h}` string" for h in header)
    parsed = rows.where("_ok").select("file", "source_line", F.from_csv("line", schema).alias("r")).select(
        "file", "source_line", *[F.coalesce(F.trim(F.col("r")[h]), F.lit("")).alias(h) for h in header])
    ragged = rows.where(~F.col("_ok")).select("file", "source_line", F.lit("MALFORMED_ROW").alias("code"))
    wrong = F.lit(False)
    for h in header:
        if h not in text_columns:
            broken = exact_number(F.col(h)).isNull()
            wrong = wrong | (broken & (F.col(h) != "") if h in optional else broken)
    numbers = parsed.where(wrong).select("file", "source_line", F.lit("INVALID_NUMBER").alias("code"))
    return parsed, notes, bad_files.unionByName(ragged).unionByName(numbers)


def scan_commented_csv(spark: SparkSession, path: str, header: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    return scan_csv(spark, path, header, comments=True)


def scan_native_csv(spark: SparkSession, path: str, header: list[str]) -> tuple[DataFrame, DataFrame]:
    rows, _, bad = scan_csv(spark, path, header, comments=False, optional=("distortion_center_x", "distortion_center_y"))
    return rows, bad


def map_native_columns(rows: DataFrame, width: int = 0, height: int = 0) -> DataFrame:
    """Native odometry columns under the canonical pose header; absent ones stay empty."""
    given = {"frame_index": "frame", "record_slot": "frame", "sensor_sec": "timestamp", "tx_m": "x", "ty_m": "y", "tz_m": "z",
             "fx_px": "fx", "fy_px": "fy", "cx_px": "cx", "cy_px": "cy"}
    fixed = {"utc_sec": "", "exposure_sec": "", "tracking_state": "unreported", "width_px": str(width), "height_px": str(height)}
    cols = [F.lit(fixed[h]).alias(h) if h in fixed else F.col(given.get(h, h)).alias(h) for h in POSE_HEADER]
    return rows.select("file", "source_line", *cols)


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


METADATA_SCHEMA = """app struct<name:string,version:string,build:string>, format_version int, capture_mode string, state string,
    coordinate_conventions struct<pose:string,recorded_camera:string,quaternion_order:string,pixel_coordinates:string,pixel_orientation:string>,
    recording_settings struct<arkit_camera:struct<max_exposure_duration_sec:double>>,
    streams map<string,struct<enabled:boolean,file:string,media_file:string,index_file:string,schema:array<string>,acceleration_conversion:string,world_alignment:string>>"""
# The one admitted export version and its conventions.
ADMITTED = {
    "app.name": "com.grape.SensorRecorder", "app.version": "1.5", "app.build": "5", "capture_mode": "arkit", "state": "finished",
    "coordinate_conventions.pose": "T_world_camera (parent_from_child): p_world = R * p_camera + t",
    "coordinate_conventions.recorded_camera": "OpenCV/Rerun RDF: x right, y down, z forward",
    "coordinate_conventions.quaternion_order": "qw,qx,qy,qz",
    "coordinate_conventions.pixel_coordinates": "origin top-left; x right, y down",
}
ACCELERATION = "CoreMotion g converted to m/s^2 using 9.80665"


def scan_capture_metadata(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Capture documents and their violations against the admitted version and streams."""
    docs = spark.read.schema(METADATA_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).json(path).select(
        F.col("_metadata.file_path").alias("file"), "*")
    same = lambda names: [F.col(n).eqNullSafe(F.lit(ADMITTED[n])) for n in names]

    def all_of(conds):
        out = F.lit(True)
        for c in conds:
            out = out & F.coalesce(c, F.lit(False))
        return out

    stream = lambda k: F.col("streams")[F.lit(k)]
    camera = []
    for k in ("wide_camera", "arkit_pose"):
        s = stream(k)
        camera += [s["enabled"], s["media_file"] == "wide.mp4", s["index_file"] == "arkit_pose.csv", s["schema"] == F.array(*[F.lit(h) for h in POSE_HEADER])]
    rules = [
        (all_of([F.col("format_version") == 1, *same(["app.name", "app.version", "app.build"])]), "UNSUPPORTED_EXPORT_VERSION"),
        (all_of(same(["capture_mode", "state"])), "UNFINISHED_OR_WRONG_MODE"),
        (all_of(same([n for n in ADMITTED if n.startswith("coordinate")])), "UNSUPPORTED_COORDINATES"),
        (all_of(camera), "UNSUPPORTED_CAMERA_SCHEMA"),
        (~F.coalesce(stream("ultrawide_camera")["enabled"], F.lit(False)) & ~F.coalesce(stream("front_camera")["enabled"], F.lit(False))
         & ~F.coalesce(stream("telephoto_camera")["enabled"], F.lit(False)), "UNSUPPORTED_MULTICAMERA"),
        (all_of([stream("arkit_pose")["world_alignment"] == "gravity"]), "UNSUPPORTED_WORLD")]
    for k, header in STREAM_HEADERS.items():
        s, on = stream(k), F.coalesce(stream(k)["enabled"], F.lit(False))
        if k in ("accelerometer", "gyroscope"):
            rules.append((on, "MISSING_REQUIRED_STREAM"))
        rules.append((~on | all_of([s["file"] == f"{k}.csv", s["schema"] == F.array(*[F.lit(h) for h in header])]), "UNSUPPORTED_STREAM_SCHEMA"))
        if k in ("accelerometer", "device_motion", "imu"):
            rules.append((~on | all_of([s["acceleration_conversion"] == ACCELERATION]), "UNSUPPORTED_UNITS"))
    codes = F.array_distinct(F.array_compact(F.array(*[F.when(~ok, F.lit(code)) for ok, code in rules])))
    return docs, docs.select("file", F.explode(codes).alias("code"))


# --- binary files -----------------------------------------------------------------

def _hash_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Content hash of large files, read in chunks from any file system pyarrow knows."""
    from pyarrow import fs

    for pdf in batches:
        out = []
        for path in pdf["file"]:
            system, name = fs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with system.open_input_stream(name) as stream:
                while chunk := stream.read(8 << 20):
                    digest.update(chunk)
            out.append(digest.hexdigest())
        yield pd.DataFrame({"file": pdf["file"], "bytes": pdf["bytes"], "sha256": out})


def inventory_assets(spark: SparkSession, root: str, roles: dict[str, str] | None = None, large_bytes: int = 1 << 30) -> DataFrame:
    """All files below a root with relative path, role, size and content hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    small = files.where(F.col("length") < large_bytes).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") >= large_bytes).select(F.col("path").alias("file"), F.col("length").alias("bytes")).mapInPandas(
        _hash_paths, "file string, bytes bigint, sha256 string")
    rel = F.regexp_replace("file", r"^\w+:/*", "/")
    base = root.rstrip("/").split(":", 1)[-1]
    out = small.unionByName(large).withColumn("path", F.substring(rel, len(base) + 2, 1 << 20))
    role = F.lit("auxiliary_excluded")
    for name, value in (roles or ROLES).items():
        role = F.when(F.col("path") == name, value).otherwise(role)
    measured = F.lit(False)
    for prefix in DEPTH_FOLDERS:
        measured = measured | F.col("path").startswith(prefix)
    return out.select("file", "path", F.when(measured, "measured_depth_excluded").otherwise(role).alias("role"), "bytes", "sha256")


def discover_photos(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Photos below a root and violations for formats that must be exported first."""
    files = inventory_assets(spark, root, {}).withColumn("suffix", X.file_suffix(F.col("path")))
    bad = files.where(F.col("suffix").isin(X.OTHER_IMAGE_SUFFIXES)).select("path", F.lit("UNSUPPORTED_IMAGE_FORMAT").alias("code"))
    photos = files.where(F.col("suffix").isin(X.KNOWN_IMAGE_SUFFIXES))
    return photos.select("path", X.parent_path(F.col("path")).alias("folder"), "bytes", "sha256"), bad


def scan_frame_images(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Frame id of each image from its all-digit stem; other names are violations."""
    files = spark.read.format("binaryFile").load(folder).select(F.col("path").alias("file"), X.file_stem(F.col("path")).alias("stem"))
    ok = F.col("stem").rlike(r"^\d+$")
    return files.where(ok).select("file", F.col("stem").cast("bigint").alias("frame")), files.where(~ok).select(
        "file", F.lit("FRAME_NAME_INVALID").alias("code"))


def _pixels(decode: Callable[[bytes], np.ndarray], value: str) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["file"], pdf["content"]):
                grid = decode(content)
                ys, xs = np.indices(grid.shape)
                yield pd.DataFrame({"file": file, "y": ys.ravel(), "x": xs.ravel(), value: grid.ravel()})
    return run


def _float_array(data: bytes) -> np.ndarray:
    """``width&height&channels&`` header and column-major little-endian floats."""
    head, at = [], 0
    for _ in range(3):
        end = data.index(b"&", at, 100)
        head.append(int(data[at:end]))
        at = end + 1
    width, height, channels = head
    if not (0 < width <= 1920 and 0 < height <= 1920 and channels == 1):
        raise ValueError("DENSE_ARRAY_INVALID")
    values = np.frombuffer(data, "<f4", offset=at)
    if values.size != width * height:
        raise ValueError("DENSE_ARRAY_INVALID")
    return values.reshape(height, width).astype(np.float64)


def scan_depth_arrays(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.col("path").alias("file"), "content")
    return files.mapInPandas(_pixels(_float_array, "z"), "file string, y bigint, x bigint, z double")


# --- extension surface ---------------------------------------------------------------

class CaptureSource(Protocol):
    """A capture layout: its asset inventory, its camera rows, and their media association."""

    name: str

    def inventory(self, spark: SparkSession, root: str) -> DataFrame: ...

    def load(self, spark: SparkSession, root: str) -> dict[str, DataFrame]: ...

    def associate(self, tables: dict[str, DataFrame], media: DataFrame) -> DataFrame: ...


class RecorderSource:
    """Sensor recorder export: commented CSV streams and a constant media clock."""

    name = "recorder"

    def inventory(self, spark, root):
        return inventory_assets(spark, root, ROLES)

    def load(self, spark, root):
        poses, notes, bad = scan_commented_csv(spark, f"{root}/arkit_pose.csv", POSE_HEADER)
        out = {"poses": poses, "comments": notes, "violations": bad}
        for stream in ("accelerometer", "gyroscope"):
            rows, _, wrong = scan_commented_csv(spark, f"{root}/{stream}.csv", STREAM_HEADERS[stream])
            out[stream], out["violations"] = rows, out["violations"].unionByName(wrong)
        return out

    def associate(self, tables, media):
        from capstrata.operators.timeseries import constant_clock
        return constant_clock(tables["frames"], media)


class NativeSource:
    """Native odometry export: plain CSV, one initial discarded frame, an affine clock."""

    name = "native"

    def inventory(self, spark, root):
        return inventory_assets(spark, root, NATIVE_ROLES)

    def load(self, spark, root):
        rows, bad = scan_native_csv(spark, f"{root}/odometry.csv", ODOMETRY_HEADER)
        imu, wrong = scan_native_csv(spark, f"{root}/imu.csv", NATIVE_IMU_HEADER)
        return {"poses": map_native_columns(rows), "odometry": rows, "imu": imu, "violations": bad.unionByName(wrong)}

    def associate(self, tables, media):
        from capstrata.operators.timeseries import affine_clock
        return affine_clock(tables["frames"], media)


SOURCES: dict[str, CaptureSource] = {s.name: s for s in (RecorderSource(), NativeSource())}


def open_source(layout: str) -> CaptureSource:
    """The layout is named by the caller and never guessed."""
    if layout not in SOURCES:
        raise ValueError(f"UNSUPPORTED_LAYOUT: {layout}")
    return SOURCES[layout]


def inspect_media(files: DataFrame, inspector: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Run a user's media inspector over (file, content) batches with a fixed output schema."""
    return files.select("file", "content").mapInPandas(inspector, schema)
