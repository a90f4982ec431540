"""Votes of normalized reviews, one profile per place.

Every review casts votes (aspect, value); votes are counted with map-side combine, so a place that holds a third of
all reviews is a few partial counts per task. Ties go to the smallest value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from placelore.functions import normalize as N
from placelore.functions import rules as R
from placelore.functions.numbers import ratio
from placelore.session import durable, pin

TAG = {"best_time": "tag_best_time", "crowd_level": "tag_crowd", "cost_level": "tag_cost"}
VALUE = {"best_time": "time_of_day", "crowd_level": "crowd_level", "cost_level": "cost_level"}


def _cast_votes():
    """array<struct<aspect, value>> of one normalized review."""
    def one(aspect, col, tag):
        return F.when(F.col(tag), F.array(F.struct(F.lit(aspect).alias("aspect"), F.col(col).cast("string").alias("value"))))

    def many(aspect, col, tag):
        return F.when(F.col(tag), F.transform(F.col(col), lambda x: F.struct(F.lit(aspect).alias("aspect"), x.alias("value"))))

    return F.flatten(F.array_compact(F.array(
        one("time_of_day", "time_of_day", "tag_best_time"), one("season", "season", "tag_best_time"),
        many("month", "months", "tag_best_time"), many("avoid", "avoid", "tag_best_time"), one("recommend", "recommend_day", "tag_best_time"),
        one("crowd", "crowd_level", "tag_crowd"), many("when", "crowd_when", "tag_crowd"),
        one("cost", "cost_level", "tag_cost"), one("amount_level", "amount_level", "tag_cost"),
        one("opinion", "opinion_level", "tag_cost"), one("fee", "fee_type", "tag_cost"))))


def votes(norm: DataFrame, place: str = "place_id") -> DataFrame:
    """(place, aspect, value, n)."""
    cast = _cast_votes()
    rows = norm.select(place, F.inline(cast)).filter("value is not null")
    return rows.groupBy(place, "aspect", "value").agg(F.count("*").alias("n"))


def ballots(norm: DataFrame, place: str = "place_id") -> DataFrame:
    """Votes, amounts and tag counts of a place in one pass over the reviews: (place, aspect, value, n)."""
    flag = lambda name, col: F.when(F.col(col), F.struct(F.lit(name).alias("aspect"), F.lit("1").alias("value")))
    more = F.array_compact(F.array(
        F.struct(F.lit("reviews").alias("aspect"), F.lit("1").alias("value")), flag("n_time", "tag_best_time"), flag("n_crowd", "tag_crowd"), flag("n_cost", "tag_cost"),
        F.when(F.col("tag_cost") & F.col("amount_lkr").isNotNull(), F.struct(F.lit("amount").alias("aspect"), F.col("amount_lkr").cast("string").alias("value")))))
    rows = norm.select(place, F.inline(F.concat(_cast_votes(), more))).filter("value is not null")
    return rows.groupBy(place, "aspect", "value").agg(F.count("*").alias("n"))


def dominant(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds rn (1 = most frequent, smallest value on ties) and the total of the group."""
    w = W.partitionBy(*keys)
    return counts.withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), "value"))).withColumn("total", F.sum("n").over(w))


def upper_median(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Element n // 2 of the sorted values, read off running counts per distinct value."""
    return median_of_counts(values.groupBy(*keys, value).agg(F.count("*").alias("c")), keys, value, "c")


def median_of_counts(counts: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    c = counts.select(*keys, value, F.col(n).alias("c"))
    w = W.partitionBy(*keys)
    run = c.withColumn("upto", F.sum("c").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    return run.filter(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(*keys).agg(F.min(value).alias("median"))


def profiles(norm: DataFrame, place: str = "place_id") -> DataFrame:
    """One flat row per place: best time, crowd and cost with confidence and what they are based on."""
    return profiles_of(durable(ballots(norm, place)), place)  # small, and read three times


def profiles_of(cast: DataFrame, place: str = "place_id") -> DataFrame:
    """``profiles`` from ballots that are counted already, for instance summed over the batches of a stream."""
    special = ["reviews", "n_time", "n_crowd", "n_cost", "amount"]
    counts = dominant(cast.filter(~F.col("aspect").isin(*special)), [place, "aspect"])
    top = lambda aspect: F.max(F.when((F.col("aspect") == aspect) & (F.col("rn") == 1), F.col("value")))
    conf = lambda aspect: F.max(F.when((F.col("aspect") == aspect) & (F.col("rn") == 1), ratio(F.col("n"), F.col("total"), 2)))

    def ordered(aspect, k=None):
        cond = F.col("aspect") == aspect
        cond = cond & (F.col("rn") <= k) if k else cond
        return F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("rn", "value")))), lambda x: x["value"])

    lvl = F.when(F.col("aspect") == "crowd", F.col("value").cast("int"))
    voted = counts.groupBy(place).agg(
        top("time_of_day").alias("time_of_day"), top("season").alias("season"), ordered("month", 6).alias("months"), ordered("avoid").alias("avoid"),
        conf("time_of_day").alias("time_confidence"), F.max(lvl).alias("crowd_level"),
        ratio(F.sum(lvl * F.col("n")), F.sum(F.when(F.col("aspect") == "crowd", F.col("n"))), 1).alias("avg_level"),
        ordered("when", 3).alias("busiest"), conf("crowd").alias("crowd_confidence"), top("crowd").alias("modal_level"), top("cost").alias("cost_level"),
        top("amount_level").alias("amount_level"), top("opinion").alias("opinion_level"), top("fee").alias("fee_type"), conf("cost").alias("cost_confidence"))
    n_of = lambda a: F.coalesce(F.sum(F.when(F.col("aspect") == a, F.col("n"))), F.lit(0))
    based = cast.groupBy(place).agg(n_of("reviews").alias("total_reviews"), n_of("n_time").alias("time_based_on"), n_of("n_crowd").alias("crowd_based_on"), n_of("n_cost").alias("cost_based_on"))
    amounts = cast.filter("aspect = 'amount'").select(place, F.col("value").cast("bigint").alias("amount_lkr"), "n")
    median = median_of_counts(amounts, [place], "amount_lkr", "n").withColumnRenamed("median", "median_lkr")
    out = based.join(voted, place, "left").join(median, place, "left").withColumn("crowd_label", N.crowd_label(F.col("crowd_level")))
    # a place without a price signal has no cost profile; one without tagged time reviews has no time profile
    out = out.withColumn("median_lkr", F.when(F.col("cost_level").isNotNull(), F.col("median_lkr")))
    return out.withColumn("time_confidence", F.when(F.col("time_based_on") > 0, F.coalesce("time_confidence", F.lit(0.0))))


def value_distributions(norm: DataFrame, place: str = "place_id") -> DataFrame:
    """Frequency variant: value counts per place; recommended days are counted among what to avoid, marked."""
    v = votes(norm, place)
    mark = F.col("aspect") == "recommend"
    v = v.withColumn("value", F.when(mark, F.concat(F.lit("RECOMMEND_"), "value")).otherwise(F.col("value"))).withColumn("aspect", F.when(mark, "avoid").otherwise(F.col("aspect")))
    return v.groupBy(place, "aspect", "value").agg(F.sum("n").alias("n"))


def distribution_maps(dist: DataFrame, place: str = "place_id") -> DataFrame:
    return dist.groupBy(place, "aspect").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("dist"))


def tag_report(norm: DataFrame, score: str = "score", place: str = "place_id") -> DataFrame:
    """Per place and in total: reviews, tagged counts, rates, mean score of tagged, reviews with any tag.

    Scores are summed as whole ten-thousandths.
    """
    s = F.round(F.col(score) * 10000).cast("bigint")
    c = norm.groupBy(place).agg(F.count("*").alias("reviews"), F.count_if(F.col("tag_best_time") | F.col("tag_crowd") | F.col("tag_cost")).alias("any_tag"),
                                *[F.count_if(t).alias(f"n_{k}") for k, t in TAG.items()], *[F.coalesce(F.sum(F.when(F.col(t), s)), F.lit(0)).alias(f"s_{k}") for k, t in TAG.items()])
    names = [x for x in c.columns if x != place]
    both = c.rollup(place).agg(*[F.sum(x).alias(x) for x in names])
    return both.select(F.coalesce(F.col(place).cast("string"), F.lit("(all)")).alias(place), "reviews", "any_tag", *[f"n_{k}" for k in TAG],
                       *[ratio(F.col(f"n_{k}"), F.col("reviews"), 4).alias(f"rate_{k}") for k in TAG],
                       *[F.coalesce(ratio(F.col(f"s_{k}"), F.col(f"n_{k}") * 10000, 4), F.lit(0.0)).alias(f"avg_{k}") for k in TAG])


def evidence(norm: DataFrame, profile: DataFrame, category: str, score: str = "score", place: str = "place_id", limit: int = 10) -> DataFrame:
    """Best example sentences of a category: reviews that voted for the dominant value first, then by score.

    A sentence (first 120 characters, lower case) is shown once per place. Both ranks keep few rows per task.
    """
    value = VALUE[category]
    tagged = norm.filter(TAG[category]).withColumn("_first", N.first_tagged(F.col("text"), category))
    rows = pin(tagged, sentence=F.col("_first")).drop("_first").filter("sentence is not null")
    dom = profile.select(place, F.col("modal_level" if category == "crowd_level" else value).alias("_dominant"))
    rows = rows.join(dom, place).withColumn("agrees", F.coalesce((F.col(value).cast("string") == F.col("_dominant")).cast("int"), F.lit(0)))
    rows = rows.withColumn("_key", F.substring(F.lower("sentence"), 1, 120))
    order = [F.desc("agrees"), F.desc(score), F.col("review_id")]
    rows = rows.withColumn("_rn", F.row_number().over(W.partitionBy(place, "_key").orderBy(*order))).filter("_rn = 1").drop("_rn")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(place).orderBy(*order))).filter(F.col("rank") <= limit)


def span_rows(norm: DataFrame) -> DataFrame:
    """One row per tagged (review, category), arrays joined by bars."""
    j = lambda c: F.array_join(c, "|")
    text = F.col("low_text")
    blank = F.lit("")
    s = lambda cat, spans, a, b: F.struct(F.lit(cat).alias("category"), spans.alias("spans"), F.coalesce(a, blank).alias("value"), F.coalesce(b, blank).alias("detail"))
    rows = F.array_compact(F.array(
        F.when(F.col("tag_best_time"), s("best_time", j(N.lexicon_spans(text, "best_time")), F.col("time_of_day"), j(F.col("months")))),
        F.when(F.col("tag_crowd"), s("crowd_level", j(N.lexicon_spans(text, "crowd_level")), F.col("crowd_level").cast("string"), j(F.col("crowd_when")))),
        F.when(F.col("tag_cost"), s("cost_level", j(N.lexicon_spans(text, "cost_level")), F.col("cost_level"), F.col("amount_lkr").cast("string")))))
    return norm.select("review_id", "place_id", F.inline(rows))


def publish(profile: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles of listed places (names compared without case), and the names that match none."""
    p = profile.withColumn("_k", F.lower("place_name"))
    known = places.select(F.lower("place_name").alias("_k"), F.col("place_name").alias("listed_name"))
    return p.join(known, "_k").drop("_k"), p.join(known, "_k", "left_anti").drop("_k")
