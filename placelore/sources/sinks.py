"""Writers. Partitioned tables and documents; every write is a plain distributed DataFrame write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelore.operators.profiles import TAG
from placelore.session import broadcast_if_small


def write_triples(triples: DataFrame, path: str) -> None:
    """JSON lines, CSV and Parquet side by side."""
    triples.write.mode("overwrite").json(f"{path}/json")
    triples.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    triples.write.mode("overwrite").parquet(f"{path}/parquet")


def write_by_place(df: DataFrame, path: str, place: str = "place_key", rows_per_file: int = 1_000_000, key: list[str] | None = None) -> None:
    """One folder per place. A place's rows are spread over as many tasks as it has files, by a hash of ``key`` (all other
    columns but maps, if not given); rows without a place go to the folder of the null value."""
    key = key or [c for c, kind in df.dtypes if c != place and "map<" not in kind]
    sizes = df.groupBy(place).agg(F.count("*").alias("_n"))
    sized = df.join(broadcast_if_small(sizes).withColumnRenamed(place, "_place"), F.col(place).eqNullSafe(F.col("_place"))).drop("_place")
    salt = F.pmod(F.xxhash64(*key) if key else F.lit(0), F.ceil(F.col("_n") / rows_per_file))
    salted = sized.repartition(F.col(place), salt).drop("_n")
    salted.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(place).json(path)


def category_tables(tagged: DataFrame) -> dict[str, DataFrame]:
    """The all-tagged table and one filtered table per category."""
    tables = {"all_tagged": tagged.filter(F.col("tag_best_time") | F.col("tag_crowd") | F.col("tag_cost"))}
    return tables | {k: tagged.filter(t) for k, t in TAG.items()}


def stats_lines(report: DataFrame, place: str = "place_id") -> DataFrame:
    """(place, doc): the report as JSON lines, one per place and one, named (all), for the summary."""
    return report.select(place, F.to_json(F.struct(*report.columns)).alias("doc"))
