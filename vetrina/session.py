"""Session helpers.

Nothing in the operators creates a session; tests and ``bench.py`` use
``local_session``. ``localCheckpoint`` is never used: lineage is cut by
writing to the shared checkpoint folder. ``checkpoint_dir`` reads
``spark.checkpoint.dir`` from the running session (the shared folder a cluster
names). Only a ``local`` master, whose tasks share the driver's disk, gets a
scratch folder where none is set; any other master gets an error.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "vetrina") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("VETRINA_DRIVER_MEMORY", "6g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a scratch folder only on a
    ``local`` master with none set."""
    try:  # a Spark Connect session has no SparkContext
        sc = spark.sparkContext
    except Exception:
        sc = None
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current and sc is not None:
        current = sc.getCheckpointDir()
    if not current:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="vetrina-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


_written: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder; ``drop_intermediates`` removes it."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/vetrina-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialise ``df`` as Parquet in the shared checkpoint folder and read
    it back: the lineage ends here (a lost executor re-reads files instead of
    recomputing), the plan downstream is a plain scan, and the scan carries
    real size statistics for AQE's join choices."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_intermediates(spark: SparkSession) -> int:
    """Remove every intermediate table that this driver has written, and count
    them. Operators such as ``match_queries``, ``keyword_search`` and
    ``mine_queries`` write such tables while they build their result, which
    reads them; the caller removes them once the result is saved."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    while _written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        removed += bool(path.getFileSystem(conf).delete(path, True))
    return removed


BROADCAST_MAX_BYTES = 64 << 20


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values: 16, 8 a column, and its texts."""
    row = F.lit(16 + 8 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        if isinstance(f.dataType, StringType):
            row = row + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        elif isinstance(f.dataType, ArrayType):
            row = row + F.coalesce(F.octet_length(F.to_json(F.col(f"`{f.name}`"))), F.lit(0))
    return row


def table_bytes(df: DataFrame) -> int:
    """Bytes of ``df``'s values, by one aggregation. Meant for small written tables."""
    return df.agg(F.sum(row_bytes(df))).first()[0] or 0


def bounded_broadcast(df: DataFrame, nbytes: int | None = None) -> DataFrame:
    """Broadcast ``df`` only after checking its size in bytes (measured, or a
    known bound such as the table it was selected from); beyond
    ``BROADCAST_MAX_BYTES`` it is returned as is and AQE plans the join
    (sort-merge, with skewed partitions split)."""
    size = table_bytes(df) if nbytes is None else nbytes
    return F.broadcast(df) if size <= BROADCAST_MAX_BYTES else df


#: More blocks than this squared would weigh on the driver's map status; AQE
#: and spilling take what is over.
MAX_SHUFFLE_PARTITIONS = 20_000


def cluster_conf(input_bytes: int, executor_cores: int = 1000 * 4) -> dict[str, str]:
    """Settings for a cluster run over ``input_bytes`` of input.

    Shuffle partitions start at ~128 MB of input each, at least twice the
    cores and ``MAX_SHUFFLE_PARTITIONS`` at most; AQE coalesces small ones at
    run time and large ones spill. Scans split at 256 MB. Skewed partitions
    (5x the median and over 256 MB) are split by AQE, also where that costs
    another shuffle. Broadcasts above 64 MB are left to sort-merge
    joins; the operators' own broadcasts are size-checked
    (``bounded_broadcast``). The checkpoint folder must be shared storage.
    """
    partitions = min(max(2 * executor_cores, input_bytes // (128 << 20)), MAX_SHUFFLE_PARTITIONS)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 << 20),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
    }
