"""Condensing a stream of blocks by micro-batches, with a store of the replaced texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..plans.builder import Pipeline, default_builder
from ..sources.store import TTL_SECONDS, alive


def condensed_stream(blocks: DataFrame, out: str, store: str, checkpoint: str, pipeline: Pipeline | None = None, query: str = "") -> DataStreamWriter:
    """A writer, to be started, that condenses each micro-batch of blocks(block_id, content).

    Each batch overwrites its own folders below `out` and `store`, so a batch run again after a failure leaves
    one copy.  The store is filled from the written results, which therefore are computed once.  block_id must
    be unique within a batch.  Paths must be shared by all executors.
    """
    steps = pipeline or default_builder().build()

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        place = f"{out}/batch={number}"
        steps.run(df, query, stored=True).write.mode("overwrite").parquet(place)
        puts = spark.read.parquet(place).select(F.explode("stored").alias("s"))
        (puts.select("s.hash", "s.payload", F.unix_timestamp().alias("at")).dropDuplicates(["hash"])
         .write.mode("overwrite").parquet(f"{store}/batch={number}"))

    return blocks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def stored_texts(spark: SparkSession, store: str, now: int | None = None, ttl: int | None = TTL_SECONDS) -> DataFrame:
    """(hash, payload, seq, at) of a stream's store: seq is the first batch that put the key, at the last time;
    entries over ttl seconds old at `now` are gone (no `now`: all are kept)."""
    x = spark.read.parquet(store).groupBy("hash").agg(F.max_by("payload", "at").alias("payload"), F.min(F.col("batch").cast("long")).alias("seq"), F.max("at").alias("at"))
    return x if now is None else alive(x, now, ttl)
