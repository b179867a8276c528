"""Session settings and the shared folder used to cut lineage."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name="lectern", master=None, **extra) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def reachable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from the driver's place.

    On a cluster of several machines the package is shipped with --py-files.
    """
    known = spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        known["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by spark.checkpoint.dir.

    A machine-local folder is chosen only for a local master with the setting unset.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the executors")
    folder = tempfile.mkdtemp(prefix="lectern-")
    context.setCheckpointDir(folder)
    return folder


def staged(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    For a frame that several branches of one plan use: it is computed once, its lineage
    ends here, its size is known to the planner, and a lost executor costs nothing.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged/{name}-{uuid.uuid4().hex}"
    out = df.repartition(partitions) if partitions else df
    out.write.mode("overwrite").parquet(path)
    frame = spark.read.schema(df.schema).parquet(path)
    frame.staged_at = path
    return frame


def dropped(*frames: DataFrame) -> None:
    """Delete the files of frames that `staged` gave, once all that was made of them is written."""
    for frame in frames:
        remove_path(frame.sparkSession, frame.staged_at)


def remove_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(target)


def spread_out(df: DataFrame, *keys: str) -> DataFrame:
    """A scan with fewer splits than cores, dealt out by key; a larger one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)
