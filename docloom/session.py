"""Session settings shared by the tests, the benchmark and batch jobs."""

from __future__ import annotations

import re
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fan-out applied to the lookup side of a join whose probe side may have hot keys.
SALT_CONF = "spark.docloom.joinSalt"


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables: ``spark.checkpoint.dir``.

    Only a local master, whose executors share the machine, gets a temporary folder when the setting is missing.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="docloom-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared)
    return shared


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint that survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated once, however often later steps use them.

    Predicates and projections above are not rewritten in terms of the inputs of
    these columns, as they would be with ``withColumns``: a chain of text
    patterns would otherwise be repeated at every use.  The one-element
    ``inline`` keeps the evaluation in the same stage.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))))


def lazily(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated once where a later step uses them, and not at all where none does.

    The index, always zero, depends on the partition as far as the optimiser knows, so it leaves the
    values where they are; unlike a generator's rows, a value that nobody reads is pruned.  A column that
    serves as a join key should not be built from other columns of this kind: plans of joins spell out their keys down to the last ``computed``.
    """
    kept = [c for c in df.columns if c not in columns]
    first = F.spark_partition_id() * 0
    return df.select(*kept, *[F.get(F.array(value), first).alias(name) for name, value in columns.items()])


def salted_join(probe: DataFrame, lookup: DataFrame, on: list[str], spread: Column, how: str = "left", salts: int | None = None) -> DataFrame:
    """Join a large probe side with a lookup side that holds one row per key.

    A hot key may own a third of the probe rows.  Probe rows are spread over
    ``joinSalt`` buckets by a hash of ``spread`` and each lookup row is repeated
    once per bucket, so no task receives a whole hot key.  Rows with a NULL key
    match nothing and are spread without bound.  AQE still turns the join into a
    broadcast when the measured lookup side is small.

    ``salts=1`` suits keys that are unique on both sides but may be NULL.
    """
    salts = salts or int(probe.sparkSession.conf.get(SALT_CONF, "8"))
    unmatched = reduce(Column.__or__, [F.col(key).isNull() for key in on])
    hashed = F.xxhash64(spread)
    salt = F.when(unmatched, F.pmod(hashed, F.lit(1 << 20)) + salts).otherwise(F.pmod(hashed, F.lit(salts)))
    bucketed = probe.withColumn("_salt", salt.cast("int"))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))) if salts > 1 else F.lit(0))
    return bucketed.join(repeated, [*on, "_salt"], how).drop("_salt")
