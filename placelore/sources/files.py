"""Readers for review, encyclopedia and table files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelore.functions import text as T

# Field names of the input files.
REVIEW_A = ("title string, body string, rating int, date string, reviewer string, contributions string, reviewer_location string, "
            "type_of_traveler string, place_name string, page_url string")
REVIEW_B = ("title string, rating int, travelDate string, publishedDate string, text string, url string, "
            "user struct<name:string,username:string,userLocation:struct<name:string,shortName:string,id:string>,contributions:struct<totalContributions:bigint,helpfulVotes:bigint>>, "
            "ownerResponse string, placeInfo struct<id:string,name:string,webUrl:string>, _source string")
ENCYCLOPEDIA = ("poi_name string, category string, city string, district string, province string, country string, latitude string, longitude string, "
                "full_address string, wikipedia_title string, wikipedia_url string, wikipedia_desc string, has_real_article boolean, rag_text string, text_length int")
NUMERIC_DEFAULTS = {"cost": 0.0, "satisfaction_score": 0.0, "duration_time_min": 60.0}


def read_reviews(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON arrays of reviews, one file per place. Spark leaves out files that start with an underscore and empty
    arrays give no rows. The place key comes from the record, else from the file name."""
    df = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file_stem", F.regexp_replace("_metadata.file_name", r"\.json$", ""))
    name = F.col("placeInfo.name") if "placeInfo" in schema else F.col("place_name")
    return df.withColumn("place_key", T.safe_key(F.coalesce(F.nullif(T.strip(F.coalesce(name, F.lit(""))), F.lit("")), F.col("file_stem"))))


def read_encyclopedia(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per file; unreadable files are dropped. Keyed by the loose name."""
    df = spark.read.schema(ENCYCLOPEDIA).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return df.filter("poi_name is not null").withColumn("key", T.loose_key(F.col("poi_name")))


def pick_column(df: DataFrame, candidates: list[str], position: int) -> str:
    """First candidate name the table has (without case), else the column at a position."""
    lower = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in lower:
            return lower[c.lower()]
    return df.columns[position]


def read_pois(spark: SparkSession, path: str) -> DataFrame:
    """Points of interest as text columns, then numbers with defaults for what does not parse."""
    df = spark.read.option("header", True).csv(path)
    name = pick_column(df, ["name", "poi_name", "place"], 1)
    out = df.withColumn("name", T.strip(F.col(name))).filter("name <> ''")
    for c, default in NUMERIC_DEFAULTS.items():
        if c in out.columns:
            out = out.withColumn(c, T.safe_float(F.col(c), default))
    for c in ("latitude", "longitude"):
        if c in out.columns:
            out = out.withColumn(c, F.col(c).try_cast("double"))
    return out


def read_past_trips(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).csv(path)
    cols = [pick_column(df, [n], i) for i, n in enumerate(("trip_id", "order", "poi"))]
    return df.select(F.col(cols[0]).alias("trip_id"), F.col(cols[1]).try_cast("int").alias("pos"), T.strip(F.col(cols[2])).alias("raw_name"))
