"""The decision log as a stream: each micro-batch's decisions change the state of the ids that they touch, and of no other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import DECISIONS


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(DECISIONS).json(folder)


def counts(stream: DataFrame, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Actions by day of decision; a day is final once the log is `delay` past it."""
    timed = stream.withColumn("at", F.try_to_timestamp(F.col("timestamp"))).where("at IS NOT NULL").withWatermark("at", delay)
    return timed.groupBy(F.window("at", window), "action").agg(F.count("*").alias("n"))


def _since(decisions: DataFrame) -> DataFrame:
    """id, d (the last decision), undone (the last undo's seq), first (the first seq since that undo), of a batch by itself."""
    undo = F.col("action") == "undo"
    last = decisions.groupBy("id").agg(F.max_by(F.struct(*decisions.columns), "seq").alias("d"), F.max(F.when(undo, F.col("seq"))).alias("undone"))
    first = decisions.join(last.select("id", "undone"), "id").where(
        F.col("seq") > F.coalesce("undone", F.lit(-1))
    ).groupBy("id").agg(F.min("seq").alias("first"))
    return last.join(first, "id", "left")


def advance(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The state (id, d, undone, first) after a batch of later decisions. An id that was taken back stays, so that what follows takes a new place."""
    new = _since(batch).select("id", *(F.col(c).alias(f"{c}_new") for c in ("d", "undone", "first")))
    both = state.join(new, "id", "full")
    first = F.when(F.col("undone_new").isNotNull(), F.col("first_new")).otherwise(F.coalesce("first", "first_new"))
    return both.select("id", F.coalesce("d_new", "d").alias("d"), F.coalesce("undone_new", "undone").alias("undone"), first.alias("first"))


_STATE = f"id string, d struct<{DECISIONS.replace(', ', ',').replace(' ', ':')}>, undone long, first long"


def materialise(spark: SparkSession, log: str, view: str, checkpoint: str) -> StreamingQuery:
    """Keeps `view` (parquet, a new version for each batch) the replay of the log; view/_current names the version to read.

    Batch n reads the version before it and its own decisions, never the log, and writes version n, so a batch that runs twice makes the same view. Decisions
    have to carry seq, rising from batch to batch."""

    def batch(decisions: DataFrame, n: int) -> None:
        state = spark.read.schema(_STATE).parquet(f"{view}/v{n - 1}") if n else spark.createDataFrame([], _STATE)
        advance(state, decisions).write.mode("overwrite").parquet(f"{view}/v{n}")
        spark.createDataFrame([(n,)], "version long").coalesce(1).write.mode("overwrite").parquet(f"{view}/_current")

    return read_log(spark, log).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, view: str) -> DataFrame:
    """The decisions that hold, with ord, as curate.replay() gives them."""
    n = spark.read.parquet(f"{view}/_current").first()["version"]
    state = spark.read.schema(_STATE).parquet(f"{view}/v{n}")
    return state.where("d.action <> 'undo'").select("d.*", F.col("first").alias("ord"))
