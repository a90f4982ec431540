"""Session helpers: a local session for tests, durable checkpoints and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("placelore")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster. A temporary one stands in only where none is set and all tasks run in
    this process; elsewhere other machines could not read it, so a missing setting is an error."""
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if not configured:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all machines share")
        configured = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(CHECKPOINT_KEY, configured)
    return configured


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so a lost executor does not replay a long loop."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage like ``durable``, in compressed columns: for tables that grow with the input. Written once, read as often as needed."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """Hint a broadcast only after counting that the side holds at most ``max_rows`` rows.

    Beyond the bound the frame is returned as it is, and the join shuffles (with skew handling by AQE).
    """
    fits = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if fits else df


def meet(rows: DataFrame, others: DataFrame, on: list[str], most: int = 200_000) -> DataFrame:
    """Inner join for few keys that many rows of both sides share: every task gets an even part of ``rows``.

    Up to ``most`` rows (counted) of ``others`` are broadcast; more of them are copied to as many parts as there are tasks.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    if others.limit(most + 1).count() <= most:
        return rows.repartition(tasks).join(F.broadcast(others), on)
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(tasks).cast("bigint"))
    copies = others.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(tasks - 1).cast("bigint"))))
    return rows.withColumn("_part", part).join(copies, [*on, "_part"]).drop("_part")


def spread(df: DataFrame) -> DataFrame:
    """Give heavy per-row work every core when a scan has fewer splits than cores; a large scan is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def pin(df: DataFrame, **columns) -> DataFrame:
    """Add columns that are computed once per row.

    A generator stands between their definition and their use, so the optimizer cannot copy a costly expression
    into every later reference (a filter on a value derived from it would otherwise be pushed below it).
    """
    row = F.struct(*[c.alias(k) for k, c in columns.items()])
    return df.select("*", F.inline_outer(F.array(row)))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
