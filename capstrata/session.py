"""Session settings and staged tables shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SLICES_KEY = "spark.capstrata.slices"


def local_session(app: str = "capstrata", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own; it is removed with the session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="capstrata-")
    _hadoop_path(spark, own)[0].deleteOnExit(_hadoop_path(spark, own)[1])
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def _hadoop_path(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def run_folder(spark: SparkSession) -> str:
    """Where this application stages tables; deleted when the driver ends."""
    folder = f"{shared_folder(spark)}/run-{spark.sparkContext.applicationId}"
    fs, path = _hadoop_path(spark, folder)
    fs.deleteOnExit(path)
    return folder


def stage(df: DataFrame) -> DataFrame:
    """Write a table once to the shared folder and read it back.

    Cuts lineage between iterations and between steps that read a result several times.
    The copy is columnar, so later steps prune columns, and it survives lost executors.
    """
    path = f"{run_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        fs, path = _hadoop_path(table.sparkSession, table.staged_at)
        fs.delete(path, True)
