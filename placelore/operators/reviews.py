"""Review table shapes: unified schema, flattening, label sheets, resume and merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from placelore.functions.text import sentence_key, strip, strip_query
from placelore.operators.dedup import keep_first


def from_source_a(df: DataFrame) -> DataFrame:
    """Flat source-A rows in the unified nested schema; blanks for missing strings, 0 for missing numbers."""
    s = lambda c: F.coalesce(F.col(c), F.lit(""))
    out = df.select(
        s("title").alias("title"), F.coalesce("rating", F.lit(0)).alias("rating"), s("date").alias("travelDate"),
        s("date").alias("publishedDate"), s("body").alias("text"), s("page_url").alias("url"),
        F.struct(s("reviewer").alias("name"), s("reviewer").alias("username"),
                 F.struct(s("reviewer_location").alias("name")).alias("userLocation"),
                 F.struct(F.coalesce(F.col("contributions").try_cast("bigint"), F.lit(0)).alias("totalContributions")).alias("contributions")).alias("user"),
        F.lit(None).cast("string").alias("ownerResponse"),
        F.struct(s("place_name").alias("name"), s("page_url").alias("webUrl")).alias("placeInfo"),
        F.lit("A").alias("_source"))
    return out.filter(strip(F.col("placeInfo.name")) != "")


def union_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def flatten(df: DataFrame, file_stem: Column) -> DataFrame:
    """Nested reviews as flat columns; missing nested values become blanks, the place falls back to the file."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.select("title", s("text").alias("text"), "rating", s("travelDate").alias("travel_date"), s("publishedDate").alias("published_date"),
                     s("url").alias("url"), s("user.name").alias("user_name"), s("user.username").alias("username"),
                     s("user.userLocation.name").alias("user_location"),
                     F.coalesce("user.contributions.totalContributions", F.lit(0)).alias("contributions"),
                     s("ownerResponse").alias("owner_response"), F.coalesce(F.nullif(s("placeInfo.name"), F.lit("")), file_stem).alias("place_name"),
                     s("placeInfo.webUrl").alias("place_url"), "_source")


def array_as_json(items: Column) -> Column:
    return F.to_json(items)


def explode_json(df: DataFrame, column: str) -> DataFrame:
    """Array text back to rows; rows whose text is not an array are skipped."""
    return df.select("*", F.explode(F.from_json(column, "array<string>")).alias("item")).filter(strip(F.col("item")) != "")


def filled(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column), F.lit(""))) != ""


def needs_label(positive: Column, column: str) -> Column:
    return positive & ~filled(column)


def without_gold(pool: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """Rows of the pool whose key is not in the gold set."""
    return pool.join(gold.select(key).distinct(), key, "left_anti")


def restore(sheet: DataFrame, old: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Human labels of an earlier sheet win over the refreshed sheet's."""
    kept = old.select(key, *[F.nullif(F.col(c), F.lit("")).alias(f"_old_{c}") for c in columns])
    out = sheet.join(kept, key, "left")
    return out.select(*[F.coalesce(f"_old_{c}", c).alias(c) if c in columns else c for c in sheet.columns])


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return work.join(done.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows over stored ones: one row per key, the new one where both exist."""
    both = old.withColumn("_p", F.lit(1)).unionByName(new.withColumn("_p", F.lit(0)))
    w = W.partitionBy(*keys).orderBy("_p")
    return both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_p")


def append_new(base: DataFrame, extra: DataFrame, text: str = "text") -> DataFrame:
    """Base rows, then extra rows whose content is not there yet (first of equal ones)."""
    key = F.md5(sentence_key(F.col(text)))
    b = base.withColumn("_k", key)
    fresh = extra.withColumn("_k", key).join(b.select("_k").distinct(), "_k", "left_anti")
    fresh = keep_first(fresh, ["_k"], ["id"], F.lit(False))
    return b.withColumn("origin", F.lit("base")).unionByName(fresh.withColumn("origin", F.lit("extra"))).drop("_k")


def match_items(items: DataFrame, places: DataFrame) -> DataFrame:
    """Delivered items to listed places: by id where both have one, else by URL without its query."""
    it = items.filter(strip(F.col("text")) != "").withColumn("bare", strip_query(F.col("url")))
    pl = places.withColumn("bare", strip_query(F.col("url"))).drop("url")
    by_id = it.join(pl.filter("place_id is not null").drop("bare"), it.item_place_id == F.col("place_id"))
    rest = it.join(pl.filter("place_id is not null").select(F.col("place_id").alias("item_place_id")), "item_place_id", "left_anti")
    by_url = rest.join(pl, "bare")
    return by_id.select("place", "text").unionByName(by_url.select("place", "text"))


def vocabularies(parts: dict[str, DataFrame]) -> DataFrame:
    frames = [df.toDF("word").select(F.lit(name).alias("vocab"), "word").distinct() for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), frames)


def conflicts(vocab: DataFrame) -> DataFrame:
    """Words that more than one vocabulary holds."""
    return (vocab.groupBy("word").agg(F.countDistinct("vocab").alias("n"), F.array_join(F.array_sort(F.collect_set("vocab")), "|").alias("vocabs"))
            .filter("n > 1"))
