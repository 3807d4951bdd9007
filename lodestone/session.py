"""Session settings and the shared folder that cut-off plans are written to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on; a caller's cluster settings for memory,
# executors and shuffle width are left alone.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # JSON objects with a repeated key keep the last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Folders of many small files are listed by so many tasks, not by one for each folder.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
}
# Whether an execution's shuffle files are deleted when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = 8, memory: str = "8g", app: str = "lodestone") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder in ``spark.checkpoint.dir``; only a single-machine session may go without one."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(spark, "_lodestone_dir", None)
        if root is None:
            root = tempfile.mkdtemp(prefix="spark-")
            spark._lodestone_dir = root
    return root.rstrip("/")


def release(spark: SparkSession) -> None:
    """Delete what this session staged; results read from it later are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lodestone/{_session_key(spark)}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _session_key(spark: SparkSession) -> str:
    return spark.sparkContext.applicationId


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{_session_key(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage with a columnar table, so what follows survives lost executors
    without recomputing the input, and later passes read only their columns.
    The shuffles of the write go with it: otherwise they stay on the executors'
    disks until the driver collects garbage, which in a large heap is never.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    kept = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, kept)
    return spark.read.schema(df.schema).parquet(path)
