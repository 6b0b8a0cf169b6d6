"""Shared pieces: reading tables, cutting lineage in the shared folder, small driver-side helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Broadcasts are limited to this many rows and bytes (as JSON); beyond either Spark plans a shuffled join.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 16 << 20


#: Texts cross into Python in batches of at most so many rows and about so many bytes. Spark's defaults (10,000 rows, 64 MB)
#: double while a batch grows, in each task and on both sides, outside the heap.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def prepare(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are no larger than BATCH."""
    conf = df.sparkSession.conf
    for key, most in BATCH.items():
        now = re.sub(r"\D", "", conf.get(key))
        if not now or int(now) > most or int(now) == 0:
            conf.set(key, str(most))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session that names none gets one of its own; on a cluster, where
    a folder of one machine would be of no use, that is an error."""
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="weftline-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def shared_uri(spark: SparkSession, name: str) -> str:
    """A new folder name inside the shared folder, as a URI that pyarrow's filesystems accept."""
    base = shared_dir(spark).rstrip("/")
    base = re.sub(r"^file:/+", "file:///", base)
    if "://" not in base:
        base = "file://" + base
    return f"{base}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Writes df to the shared checkpoint folder, so that lost executors cost no recomputation.

    narrow is for tables far smaller than the shuffle they come from: they are written in an eighth as many files as a
    shuffle has partitions, though never in fewer than two for each core.
    """
    spark = df.sparkSession
    shared_dir(spark)
    if narrow:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    return df.checkpoint(eager=True)


def drop_folder(spark: SparkSession, uri: str) -> None:
    """Deletes a folder that this session wrote, through Spark's file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast only if it was counted and has at most so many rows and bytes. df should be cheap to count."""
    found = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return F.broadcast(df) if found[0] <= rows and found[1] <= size else df


def id_crc(col: Column) -> Column:
    """crc32 of an integer id's decimal text; null for a null id."""
    return F.crc32(col.cast("string").cast("binary"))


def crc_of(value) -> int:
    return zlib.crc32(str(value).encode())
