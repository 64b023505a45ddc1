"""Publication: staged tables, checks, and a manifest row written last."""

from __future__ import annotations

import hashlib
import posixpath
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capstrata.operators.integrity import ContractViolation, enforce
from capstrata.session import _hadoop_path

MANIFEST = "run_id string, schema string, capture_id string, tables map<string,string>, published_sec double, status string"


def _norm(path: str) -> str:
    return posixpath.normpath(path.split(":", 1)[-1])


def check_overlap(target: str, sources: list[str]) -> None:
    t = _norm(target) + "/"
    for s in sources:
        o = _norm(s) + "/"
        if t.startswith(o) or o.startswith(t):
            raise ContractViolation("OUTPUT_SOURCE_OVERLAP", target)


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """Published runs only: a run without its manifest row does not exist for readers."""
    try:
        return spark.read.schema(MANIFEST).json(f"{root}/_manifests")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)


def _create_new(spark: SparkSession, path: str, content: str) -> bool:
    """Create a file that must not exist; False if another writer did.

    HDFS creates without overwriting atomically, and so does the driver's own file system.
    """
    fs, at = _hadoop_path(spark, path)
    fs.mkdirs(at.getParent())
    if fs.getUri().getScheme() == "file":
        try:
            with open(at.toUri().getPath(), "x") as out:
                out.write(content)
        except FileExistsError:
            return False
        return True
    try:
        out = fs.create(at, False)
    except Py4JJavaError as failure:
        if "FileAlreadyExists" in failure.java_exception.getClass().getName():
            return False
        raise
    out.write(bytearray(content.encode()))
    out.close()
    return True


def claim(spark: SparkSession, root: str, capture_id: str, run: str, stale_after_sec: float | None = None) -> str:
    """Take the right to publish a capture; the path of the claim, or OUTPUT_CLAIMED.

    A claim older than ``stale_after_sec`` was left by a writer that died; it is moved aside
    first. Without that parameter claims never expire.
    """
    path = f"{root}/_claims/{hashlib.sha256(capture_id.encode()).hexdigest()}"
    if _create_new(spark, path, run):
        return path
    fs, at = _hadoop_path(spark, path)
    if stale_after_sec is not None and fs.exists(at):
        age = time.time() - fs.getFileStatus(at).getModificationTime() / 1000
        if age >= stale_after_sec and fs.rename(at, _hadoop_path(spark, f"{path}.stale-{run}")[1]) and _create_new(spark, path, run):
            return path
    raise ContractViolation("OUTPUT_CLAIMED", capture_id)


def _holds(spark: SparkSession, path: str, run: str) -> bool:
    rows = spark.read.text(path).collect() if _hadoop_path(spark, path)[0].exists(_hadoop_path(spark, path)[1]) else []
    return [r["value"] for r in rows] == [run]


def publish_once(spark: SparkSession, tables: dict[str, DataFrame], root: str, capture_id: str, *, schema: str = "canonical-capture-1",
                 checks: dict[str, DataFrame] | None = None, sources: list[str] | None = None, stale_after_sec: float | None = None) -> str:
    """Write the tables of a capture once.

    The writer claims the capture, writes the tables into the run's own partitions, runs the
    violation checks and adds the manifest row last, if the claim is still its own. A failure
    removes the partitions, leaves a FAILED report and no manifest, and frees the claim, so
    nothing half-written is ever read. Publishing a capture a second time is refused.
    """
    check_overlap(root, sources or [])
    run = f"r{uuid.uuid4().hex}"
    held = claim(spark, root, capture_id, run, stale_after_sec)
    paths = {name: f"{root}/tables/{name}/schema={schema}/publication_run={run}" for name in tables}
    try:
        if read_manifests(spark, root).where(F.col("capture_id") == capture_id).limit(1).count():
            raise ContractViolation("OUTPUT_EXISTS", capture_id)
        for bad in (checks or {}).values():
            enforce(bad)
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(paths[name])
        if not _holds(spark, held, run):
            raise ContractViolation("OUTPUT_CLAIMED", capture_id)
        _row(spark, run, schema, capture_id, paths, "READY_WITH_FINDINGS").coalesce(1).write.mode("append").json(f"{root}/_manifests")
    except Exception as failure:
        for path in paths.values():
            fs, at = _hadoop_path(spark, path)
            fs.delete(at, True)
        _row(spark, run, schema, capture_id, paths, "FAILED").withColumn("error", F.lit(str(failure))).write.mode("append").json(f"{root}/_failed")
        raise
    finally:
        if _holds(spark, held, run):
            fs, at = _hadoop_path(spark, held)
            fs.delete(at, False)
    return run


def _row(spark: SparkSession, run: str, schema: str, capture_id: str, paths: dict[str, str], status: str) -> DataFrame:
    tables = F.create_map(*[F.lit(x) for kv in paths.items() for x in kv]) if paths else F.lit(None)
    return spark.range(1).select(
        F.lit(run).alias("run_id"), F.lit(schema).alias("schema"), F.lit(capture_id).alias("capture_id"), tables.cast("map<string,string>").alias("tables"),
        F.expr("unix_micros(current_timestamp()) / 1000000").alias("published_sec"), F.lit(status).alias("status"))


# Schema versions a reader accepts.
KNOWN_SCHEMAS = ["canonical-capture-1", "canonical-capture-2"]


def open_capture(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One table over all published captures, whatever accepted schema version they have.

    Runs are partitions of the table; a join with the manifest admits the published ones and
    prunes the others, so the driver lists no captures. Of two manifests of one capture, left by
    writers on both sides of a stale claim, the earlier one counts.
    """
    runs = read_manifests(spark, root)
    unknown = runs.where(~F.col("schema").isin(KNOWN_SCHEMAS)).limit(1).collect()
    if unknown:
        raise ContractViolation("UNKNOWN_SCHEMA", unknown[0]["schema"])
    admitted = runs.groupBy("capture_id").agg(F.min(F.struct("published_sec", "run_id"))["run_id"].alias("publication_run")).select("publication_run")
    out = None
    for version in KNOWN_SCHEMAS:
        base = f"{root}/tables/{table}/schema={version}"
        fs, at = _hadoop_path(spark, base)
        if not fs.exists(at) or not fs.listStatus(at):
            continue
        part = spark.read.option("basePath", base).parquet(base).join(admitted, "publication_run", "left_semi").drop("publication_run")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ContractViolation("CAPTURE_NOT_READY", table)
    return out


def sink_csv_crlf(df: DataFrame, path: str, order: list[str]) -> None:
    """CSV with CRLF line ends, rows in a total order."""
    df.orderBy(*order).write.option("header", True).option("lineSep", "\r\n").csv(path)


def sink_jsonl(df: DataFrame, path: str) -> None:
    """One object per line with sorted keys; NaN and infinities are refused."""
    bad = F.lit(False)
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            bad = bad | F.isnan(f.name) | (F.abs(F.col(f.name)) == float("inf"))
    if df.where(bad).limit(1).count():
        raise ContractViolation("NONFINITE_VALUE", path)
    df.select(*sorted(df.columns)).write.option("ignoreNullFields", False).json(path)


def sink_cloud(cloud: DataFrame, path: str) -> None:
    """Voxel cloud as Parquet by capture."""
    cloud.write.partitionBy("capture_id").parquet(path)


def sink_point_list(cloud: DataFrame, path: str) -> None:
    """ASCII points: x y z r g b per line, partitioned by capture."""
    xyz = [F.format_string("%.9g", F.col(c)) for c in "xyz"]
    cloud.select("capture_id", F.concat_ws(" ", *xyz, *[F.col(c).cast("string") for c in "rgb"]).alias("value")).write.partitionBy("capture_id").text(path)
