"""A session with the settings that the library relies on, and tables in the folder that its executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """UTC time, adaptive execution, and Arrow for pandas functions; ``conf`` adds or replaces settings."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.master(master).config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; a cluster has no folder to guess, so that is an error.
    """
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="engramlake-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
        at = sc.getCheckpointDir() or at
    return at.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and safe from lost executors. Gone when the driver ends."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_clear, df.sparkSession)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_written: list[str] = []


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes files or folders wherever Spark can reach them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def _clear(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        remove(spark, *_written)
