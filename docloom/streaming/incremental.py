"""Incremental synchronisation: a stream of document versions against stored state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DOCUMENT_SCHEMA = "path string, text string, modified timestamp"
STATE_SCHEMA = "path string, modified timestamp, source_digest string, page_version int"


def latest_versions(batch: DataFrame, options: str = "{}") -> DataFrame:
    """Digest of the last version of each path.

    Texts are reduced to digests where they are read, and copies are dropped
    before the shuffle by the aggregate.
    """
    digest = F.md5(F.concat(F.lit(options + "\n"), F.col("text"))).alias("source_digest")
    last = F.max(F.struct("modified", digest)).alias("last")
    return batch.groupBy("path").agg(last).select("path", "last.modified", "last.source_digest")


def plan_batch(batch: DataFrame, state: DataFrame, options: str = "{}") -> DataFrame:
    """Actions of one batch: create, update, unchanged, or stale for versions older than the stored one."""
    latest = latest_versions(batch, options)
    old = state.select("path", F.col("modified").alias("old_modified"), F.col("source_digest").alias("old_digest"), "page_version")
    joined = latest.join(old, "path", "left")
    action = (
        F.when(F.col("page_version").isNull(), "create")
        .when(F.col("modified") < F.col("old_modified"), "stale")
        .when(F.col("source_digest") == F.col("old_digest"), "unchanged")
        .otherwise("update"))
    version = F.when(F.col("page_version").isNull(), 1).otherwise(F.col("page_version") + 1)
    out = joined.withColumn("action", action)
    return out.select("path", "action", "modified", "source_digest",
                      F.when(F.col("action").isin("create", "update"), version).otherwise(F.col("page_version")).alias("page_version"))


def advance_state(state: DataFrame, plan: DataFrame) -> DataFrame:
    """State after a plan: planned paths replace their old rows."""
    moved = plan.where("action IN ('create', 'update', 'unchanged')").select("path", "modified", "source_digest", "page_version")
    return state.join(moved.select("path"), "path", "left_anti").unionByName(moved)


def incremental_sync(documents: DataFrame, state_dir: str, plan_dir: str, checkpoint_dir: str, options: str = "{}") -> StreamingQuery:
    """Process what is available in micro-batches; each writes its plan and the next state.

    Batch ``n`` reads state ``n`` and overwrites plan ``n`` and state ``n + 1``, so
    a batch that runs again after a failure gives the same result.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = read_state(spark, state_dir, batch_id)
        plan_batch(batch, state, options).write.mode("overwrite").parquet(f"{plan_dir}/batch={batch_id}")
        plan = spark.read.parquet(f"{plan_dir}/batch={batch_id}")
        advance_state(state, plan).write.mode("overwrite").parquet(f"{state_dir}/version={batch_id + 1}")

    return (
        documents.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True).start())


def read_state(spark: SparkSession, state_dir: str, version: int) -> DataFrame:
    if version == 0:
        return spark.createDataFrame([], STATE_SCHEMA)
    return spark.read.schema(STATE_SCHEMA).parquet(f"{state_dir}/version={version}")
