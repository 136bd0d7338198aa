"""Session helpers: shared work folder and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Settings a cluster session should carry; none is forced by the library.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

def compute_once(df: DataFrame, *columns: Column) -> DataFrame:
    """Add aliased columns whose expressions must not be copied into later steps.

    Catalyst moves filters below projections by copying the expressions they
    read, again and again along a chain. A one-row ``inline`` stops that: costly
    columns such as regular expressions are evaluated once per row. It stays
    map-only.
    """
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def work_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    ``spark.checkpoint.dir`` decides. Only a local session without that setting
    gets a temporary folder; on a cluster a machine-local folder would lose data
    with its executor, so the setting is required there.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = tempfile.mkdtemp(prefix="graphloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for one run, inside the shared work folder."""
    return f"{work_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


_STORED: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared work folder, removed when the application ends.

    For loops of joins: a checkpoint keeps the estimated size of its plan, which
    every further join multiplies, while a small table has the size that it has,
    and any other one none, see ``unsized``.
    """
    spark = df.sparkSession
    path = run_dir(spark, "step")
    if not _STORED:
        atexit.register(_remove_stored)
    _STORED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    small = size * _PACKED <= spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return table if small else unsized(table)


# times that a table in memory is larger than its file, about, for a plan to broadcast it by the size of the file
_PACKED = 16


def unsized(df: DataFrame) -> DataFrame:
    """The same rows without an estimated size: joins on them broadcast by the bytes that adaptive execution measures.

    A plan takes a compressed file for its rows, so 10 MB of file would pass for
    a small side and be built as a hash table of hundreds of MB in the driver. An
    empty RDD beside the rows has no known size, and no partitions.
    """
    spark = df.sparkSession
    return df.union(spark.createDataFrame(spark.sparkContext.emptyRDD(), df.schema))


def _remove_stored() -> None:
    gateway = SparkContext._gateway
    if gateway is None:
        return
    jvm = gateway.jvm
    for path in _STORED:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and keeps the partitioning."""
    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def merged(df: DataFrame) -> DataFrame:
    """A side that grows with the documents: its join sorts and spills, whatever size the plan expects.

    Rows that ``inline`` or ``explode`` make are not in that size, so a table of
    all documents would pass for a small one and be built whole in every task.
    """
    return df.hint("merge")


def spread(scan: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores one partition per core; any other scan stays as it is.

    Text rules cost far more than reading, so a small file in one row group would
    keep one core busy. An input of many splits is never shuffled. For plans
    without an exchange only.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
