"""Deterministic stratified samples: order by a digest of (seed, key), so a retried task draws the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from placelore.session import broadcast_if_small


def draw(seed: int, *keys) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def stratified(df: DataFrame, strata: list[str], n: Column | int, seed: int, keys: list[str]) -> DataFrame:
    """``n`` rows per stratum."""
    w = W.partitionBy(*strata).orderBy("_draw", *keys)
    limit = F.lit(n) if isinstance(n, int) else n
    return (df.withColumn("_draw", draw(seed, *keys)).withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= limit).drop("_draw", "_rn"))


def one_per(df: DataFrame, group: str, seed: int, keys: list[str]) -> DataFrame:
    return stratified(df, [group], 1, seed, keys)


def borderline(scores: DataFrame, thresholds: DataFrame, below: float = 0.05, above: float = 0.05) -> DataFrame:
    """Rows within the band around their class threshold, labelled by side."""
    s, t = F.col("score"), F.col("threshold")
    band = F.when((s >= t) & (s <= t + above), "above").when((s < t) & (s >= t - below), "below")
    return scores.join(broadcast_if_small(thresholds), "category").withColumn("band", band).filter(F.col("band").isNotNull())


def borderline_sample(banded: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """Half above, half below per class; a key drawn for one class is not drawn again for a later one."""
    first = W.partitionBy(key).orderBy("category")
    once = banded.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")
    return stratified(once, ["category", "band"], max(1, n // 2), seed, [key])
