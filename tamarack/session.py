"""Session helpers: settings for local runs, table loading, and materialised intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "tamarack", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that a cluster session should carry too (AQE, UTC, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``table``, spread over all cores if it is read in fewer parts than there are cores.

    A small file is one part, which would leave a whole text operator to one core; an input of many parts is read as
    it is, without a shuffle.
    """
    df = table(spark, root, name)
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only on a single machine (a local master), and where the setting is absent, a temporary folder is made; on a cluster
    a folder of one machine would lose rows, so there the setting is needed.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = getattr(spark.sparkContext, "_tamarack_folder", None)
    if current is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = "file://" + tempfile.mkdtemp(prefix="tamarack-")
        spark.sparkContext._tamarack_folder = current
    return current


_written: list[tuple[SparkSession, str]] = []


def release_tables() -> int:
    """Delete the intermediate tables written so far, once the results that read them are stored; their number.

    A session that runs many queries calls this between them; otherwise the tables go when the process ends.
    """
    gone = 0
    while _written:
        spark, path = _written.pop()
        jvm, sc = spark._jvm, spark.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        gone += 1
    return gone


def _clean() -> None:
    try:
        release_tables()
    except Exception:  # the session has ended; the shared folder's owner removes the rest
        return


atexit.register(_clean)


def materialise(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts the lineage as ``checkpoint()`` does, survives the loss of executors, and is compressed and
    columnar, so later stages read only the columns they need. The files go with ``release_tables`` or when the process
    ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tamarack-{os.getpid()}-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)
