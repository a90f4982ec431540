"""The review pipeline as a file stream that keeps the profile of every place up to date.

A checkpoint remembers the files that are done. Reviews are cleaned and, with a watermark, taken once within its span. A
micro-batch leaves two tables behind, each in a folder named by the batch number and overwritten if the batch is run
again, so a replay changes nothing:

* ``ballots/batch=N``: the votes, amounts and tag counts of the batch. After every ``every`` batches the sums of all
  so far are written to ``sums/batch=N``; later batches add to the last sums, so what is read stays small.
* ``profiles/batch=N``: all profiles after the batch - those of the places it touched made anew, the others taken over.

Which folders count follows from the batch number alone: nothing is listed, and nothing is read twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from placelore.functions import normalize as N
from placelore.operators import profiles as P

EVERY = 10


def clean_stream(reviews: DataFrame, watermark: str | None = None, ts: str = "ts", keys: tuple[str, ...] = ("place_key", "url")) -> DataFrame:
    """Normalized reviews. With a watermark, a review (its ``keys``) is taken once within that span, and rows that come
    later than the span behind the newest one are left out."""
    if watermark:
        reviews = reviews.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(keys))
    return N.normalized(reviews)


def last_sums(batch_id: int, every: int = EVERY) -> int:
    """The newest batch up to ``batch_id`` after which sums were written, or -1."""
    return (batch_id + 1) // every * every - 1


def ballots_until(spark: SparkSession, out: str, batch_id: int, place: str = "place_key", every: int = EVERY) -> DataFrame:
    """(place, aspect, value, n) over all batches up to ``batch_id``: the last sums and the batches after them."""
    base = last_sums(batch_id, every)
    return _parts(spark, out, base, range(base + 1, batch_id + 1), place)


def _parts(spark: SparkSession, out: str, base: int, batches: range, place: str) -> DataFrame:
    paths = [f"{out}/sums/batch={base}"] if base >= 0 else []
    rows = spark.read.parquet(*paths, *[f"{out}/ballots/batch={i}" for i in batches])
    return rows.groupBy(place, "aspect", "value").agg(F.sum("n").alias("n"))


def upsert_profiles(stored: DataFrame | None, fresh: DataFrame, place: str = "place_key") -> DataFrame:
    """Fresh profiles over stored ones."""
    if stored is None:
        return fresh
    return stored.join(fresh.select(place), place, "left_anti").unionByName(fresh)


def fold_batch(batch: DataFrame, batch_id: int, out: str, place: str = "place_key", every: int = EVERY) -> None:
    """Take one micro-batch of normalized reviews into ballots, sums and profiles; running it again gives the same."""
    spark = batch.sparkSession
    P.ballots(batch, place).write.mode("overwrite").parquet(f"{out}/ballots/batch={batch_id}")
    if last_sums(batch_id, every) == batch_id:
        _parts(spark, out, last_sums(batch_id - 1, every), range(last_sums(batch_id - 1, every) + 1, batch_id + 1), place).write.mode("overwrite").parquet(f"{out}/sums/batch={batch_id}")
    touched = spark.read.parquet(f"{out}/ballots/batch={batch_id}").select(place).distinct()
    fresh = P.profiles_of(ballots_until(spark, out, batch_id, place, every).join(touched, place, "left_semi"), place)
    stored = spark.read.parquet(f"{out}/profiles/batch={batch_id - 1}") if batch_id else None
    upsert_profiles(stored, fresh, place).write.mode("overwrite").parquet(f"{out}/profiles/batch={batch_id}")


def profile_stream(source: DataFrame, out: str, checkpoint: str, place: str = "place_key", every: int = EVERY) -> StreamingQuery:
    """Start a run over all files that are new since the checkpoint, then stop. ``out`` and ``checkpoint`` are two folders."""
    def write(batch: DataFrame, batch_id: int) -> None:
        fold_batch(batch, batch_id, out, place, every)

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_batch(spark: SparkSession, out: str) -> int:
    """The newest batch whose profiles are complete."""
    return spark.read.option("basePath", f"{out}/profiles").parquet(f"{out}/profiles").select(F.max("batch")).first()[0]


def current_profiles(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/profiles/batch={last_batch(spark, out)}")


def total_ballots(spark: SparkSession, out: str, place: str = "place_key", every: int = EVERY) -> DataFrame:
    return ballots_until(spark, out, last_batch(spark, out), place, every)
