"""Forecast slots to days, place-by-day grids, and what the weather removes or demotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from placelore.functions import rules as R


def is_bad(main: Column, description: Column) -> Column:
    return F.lower(F.coalesce(main, F.lit(""))).isin(*R.BAD_WEATHER_MAIN) | F.lower(F.coalesce(description, F.lit(""))).rlike("|".join(R.BAD_WEATHER_WORDS))


def daily(slots: DataFrame) -> DataFrame:
    """Per place and date: bad when bad slots >= max(1, a third of the slots); the middle slot is shown."""
    w = W.partitionBy("place_id", "date")
    x = slots.withColumn("rn", F.row_number().over(w.orderBy("ts", "slot_id"))).withColumn("n", F.count("*").over(w))
    mid = F.col("rn") == F.floor(F.col("n") / 2) + 1
    g = x.groupBy("place_id", "date").agg(F.count("*").alias("slots"), F.count_if(is_bad(F.col("main"), F.col("description"))).alias("bad_slots"),
                                          F.max(F.when(mid, F.col("main"))).alias("main"), F.max(F.when(mid, F.col("temp"))).alias("temp"))
    return g.withColumn("is_bad", F.col("bad_slots") >= F.greatest(F.lit(1), F.floor(F.col("slots") / 3)))


def grid(places: DataFrame, days: DataFrame, start: str, n_days: int) -> DataFrame:
    """Every place on every trip day; days without forecast are not bad. The days are a short generated list."""
    trip = F.sequence(F.to_date(F.lit(start)), F.date_add(F.to_date(F.lit(start)), n_days - 1))
    cells = places.select("place_id", F.posexplode(trip).alias("i", "date")).withColumn("day", F.col("i") + 1).drop("i")
    g = cells.join(days, ["place_id", "date"], "left")
    label = F.when(F.col("is_bad"), F.concat(F.lit("! "), F.col("main"))).otherwise(F.coalesce("main", F.lit("No forecast")))
    return g.withColumn("is_bad", F.coalesce("is_bad", F.lit(False))).withColumn("cell", label)


def wide_grid(g: DataFrame, n_days: int) -> DataFrame:
    return g.groupBy("place_id").pivot("day", list(range(1, n_days + 1))).agg(F.first("cell")).withColumnsRenamed({str(i): f"day_{i}" for i in range(1, n_days + 1)})


def kept_places(g: DataFrame, n_days: int, start_place: Column) -> DataFrame:
    """Without places bad on all days or on at least n // 2 + 1 of them; the start place always stays."""
    bad = g.groupBy("place_id").agg(F.count_if("is_bad").alias("bad_days"))
    return bad.filter((F.col("place_id") == start_place) | ~((F.col("bad_days") == n_days) | (F.col("bad_days") >= n_days // 2 + 1)))


def rerank(routes: DataFrame, day_stops: DataFrame, g: DataFrame) -> DataFrame:
    """Routes by the number of stops that meet bad weather on their day, then by score."""
    bad = day_stops.join(g.filter("is_bad").select("place_id", "day"), ["place_id", "day"]).groupBy("req_id").agg(F.count("*").alias("penalty"))
    return routes.join(bad, "req_id", "left").withColumn("penalty", F.coalesce("penalty", F.lit(0)))
