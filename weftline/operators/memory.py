"""Message logs: tables of (conv_id, id, role, content, ts). Higher ids are later; ids are never used again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..sources.files import children, delete

SCHEMA = "conv_id long NOT NULL, id long NOT NULL, role string NOT NULL, content string NOT NULL, ts timestamp"


def create_table(spark: SparkSession, name: str) -> None:
    """Creates an empty log once; an existing one stays as it is."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (conv_id BIGINT, id BIGINT, role STRING, content STRING, ts TIMESTAMP) USING parquet")


def _snapshots(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished snapshots below path, oldest first."""
    return sorted(x for x in children(spark, path) if x.startswith("v-") and "_SUCCESS" in children(spark, f"{path}/{x}/water"))


def open_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The log kept at path, and the largest id that each conversation ever had; both empty if there is none yet."""
    kept = _snapshots(spark, path)
    if not kept:
        return spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "conv_id long, last_id long")
    return spark.read.parquet(f"{path}/{kept[-1]}/log"), spark.read.parquet(f"{path}/{kept[-1]}/water")


def keep_log(log: DataFrame, path: str, water: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Writes a log as the newest snapshot at path and reads it back; earlier snapshots go once it is there.

    A snapshot counts when its second table is finished, so a run that breaks off leaves the log before it.
    """
    spark = log.sparkSession
    before = children(spark, path)
    number = max((int(x[2:]) for x in before if x.startswith("v-")), default=0) + 1
    last = log.groupBy("conv_id").agg(F.max("id").alias("last_id"))
    if water is not None:
        last = last.unionByName(water.select("conv_id", "last_id")).groupBy("conv_id").agg(F.max("last_id").alias("last_id"))
    own = f"{path}/v-{number:012d}"
    log.write.parquet(f"{own}/log")
    last.coalesce(1).write.parquet(f"{own}/water")
    for x in before:
        if x.startswith("v-"):
            delete(spark, f"{path}/{x}")
    return open_log(spark, path)


def append(log: DataFrame, new: DataFrame, high_water: DataFrame | None = None) -> DataFrame:
    """log with the rows of new (conv_id, ord, role, content) after it, numbered by ord from each conversation's largest id.

    high_water (conv_id, last_id) keeps numbering after rows were cleared.
    """
    last = log.groupBy("conv_id").agg(F.max("id").alias("last_id"))
    if high_water is not None:
        last = last.unionByName(high_water.select("conv_id", "last_id")).groupBy("conv_id").agg(F.max("last_id").alias("last_id"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("ord"))
    numbered = new.join(last, "conv_id", "left").withColumn("id", F.coalesce("last_id", F.lit(0)) + number)
    return log.unionByName(numbered.select("conv_id", "id", "role", "content", F.current_timestamp().alias("ts")))


def clear(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The empty log, and the largest ids so far for `append`."""
    return log.limit(0), log.groupBy("conv_id").agg(F.max("id").alias("last_id"))


def _latest(log: DataFrame, n: int) -> DataFrame:
    return log.withColumn("__rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("id")))).filter(F.col("__rank") <= n).drop("__rank")


def prune(log: DataFrame, n: int) -> DataFrame:
    """The n latest messages of each conversation."""
    if n < 1:
        raise ValueError("at least one row must stay")
    return _latest(log, n)


def recent(log: DataFrame, limit: int = 5) -> DataFrame:
    """conv_id and history: the latest messages, oldest first; none for 0, all for a negative limit."""
    rows = log if limit < 0 else _latest(log, limit) if limit else log.limit(0)
    entries = F.transform(F.array_sort(F.collect_list(F.struct("id", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return rows.groupBy("conv_id").agg(entries.alias("history"))


def latest_of_log(log: DataFrame, limit: int = 5) -> DataFrame:
    """The latest messages of one log as a whole, oldest first: a bounded top-k."""
    rows = log.orderBy(F.desc("conv_id"), F.desc("id"))
    return (rows if limit < 0 else rows.limit(limit)).orderBy("conv_id", "id")


def update_last(log: DataFrame, content) -> DataFrame:
    """log with the content of each conversation's last message replaced; an empty log is an error."""
    if not log.take(1):
        raise RuntimeError("there is no message to update")
    last = F.col("id") == F.max("id").over(Window.partitionBy("conv_id"))
    return log.withColumn("content", F.when(last, content).otherwise(F.col("content")))


def history_before(messages: DataFrame, k: int, order: str = "id") -> DataFrame:
    """messages with `history`: the k messages before each one, oldest first.

    The window reaches back k rows only; the message itself is not in it.
    """
    frame = Window.partitionBy("conv_id").orderBy(order).rowsBetween(-k, -1)
    return messages.withColumn("history", F.collect_list(F.struct("role", "content")).over(frame) if k else F.array().cast("array<struct<role:string,content:string>>"))
