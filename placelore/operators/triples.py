"""Place-term tables: mention counts, popularity, TF-IDF and what follows from them.

Input is a long mention table (kind, place_id, term, evidence_id, sentiment, conf_c) with confidence in
hundredths. All aggregations combine map-side; a place that holds a third of the mentions only ever reaches a
reducer as one partial row per (place, term) and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from placelore.functions.numbers import ratio

KEYS = ["kind", "place_id", "term"]


def dominant_sentiment(pos: Column, neg: Column, neu: Column) -> Column:
    """Largest count; positive, then negative, then neutral on ties."""
    return (F.when((pos >= neg) & (pos >= neu), "positive").when(neg >= neu, "negative").otherwise("neutral"))


def summary_sentiment(pos: Column, neg: Column, neu: Column) -> Column:
    """Batch-summary variant: only positive wins ties; otherwise the first largest in listing order."""
    top = F.greatest(pos, neg, neu)
    return F.when(pos == top, "positive").when(neg == top, "negative").otherwise("neutral")


def mention_counts(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy(*KEYS).agg(
        F.count("*").alias("mentions"), F.countDistinct("evidence_id").alias("review_count"),
        F.sum("conf_c").alias("conf_sum"), F.count_if(F.col("sentiment") == "positive").alias("pos"),
        F.count_if(F.col("sentiment") == "negative").alias("neg"),
        F.count_if(F.col("sentiment") == "neutral").alias("neu"))


def popularity(mentions: DataFrame, totals: DataFrame) -> DataFrame:
    """Counts joined to per-place review totals; places without a total are dropped."""
    return (mention_counts(mentions).join(totals, "place_id")
            .withColumn("pct", ratio(F.col("review_count") * 100, F.col("total_reviews"), 2))
            .withColumn("avg_confidence", ratio(F.col("conf_sum"), F.col("mentions") * 100, 4))
            .withColumn("sentiment", dominant_sentiment(F.col("pos"), F.col("neg"), F.col("neu"))))


def popular(pop: DataFrame, min_pct: float = 10.0, min_reviews: int = 5) -> DataFrame:
    """The cut is taken on the exact share, not on its rounded form."""
    share = F.col("review_count") * 100.0 / F.col("total_reviews")
    return pop.filter((share >= min_pct) & (F.col("review_count") >= min_reviews))


def top_per_place(rows: DataFrame, order: list[Column], n: int = 5, keys=("kind", "place_id")) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def noise_filter(counts: DataFrame, min_mentions: int = 5, min_confidence: float = 0.75) -> DataFrame:
    return counts.filter((F.col("mentions") >= min_mentions)
                         & (F.col("conf_sum") >= min_confidence * 100 * F.col("mentions")))


def tf_idf(counts: DataFrame) -> DataFrame:
    """TF within a place, ln(places / places with the term), and the product weighted by confidence.

    ``counts`` has one row per (place, term): place totals, document frequencies and the number of places are
    three small aggregates joined back.
    """
    places = counts.groupBy("kind", "place_id").agg(F.sum("mentions").alias("place_mentions"))
    terms = counts.groupBy("kind", "term").agg(F.count("*").alias("df"))
    kinds = places.groupBy("kind").agg(F.count("*").alias("n_places"))
    return (counts.join(places, ["kind", "place_id"]).join(terms, ["kind", "term"]).join(kinds, "kind")
            .withColumn("tf", F.col("mentions") / F.col("place_mentions"))
            .withColumn("idf", F.log(F.col("n_places") / F.col("df")))
            .withColumn("tf_idf", F.col("tf") * F.col("idf"))
            .withColumn("defining_score", F.col("tf_idf") * F.col("conf_sum") / (100 * F.col("mentions"))))


def term_frequency(pop: DataFrame) -> DataFrame:
    """Share of places (percent) that have a term, per kind."""
    n = pop.select("kind", "place_id").distinct().groupBy("kind").agg(F.count("*").alias("n_places"))
    df = pop.groupBy("kind", F.lower("term").alias("term")).agg(F.countDistinct("place_id").alias("df"))
    return df.join(n, "kind").withColumn("freq_pct", F.col("df") * 100 / F.col("n_places"))


def dynamic_threshold(min_freq: Column, base: float = 20.0, floor: float = 0.0) -> Column:
    """Quadratic ramp between 5 % and 30 % of the rarest term's frequency."""
    ramp = F.pow((min_freq - 5.0) / 25.0, F.lit(2)) * base
    return (F.when(min_freq >= 30.0, F.lit(base)).when(min_freq <= 5.0, F.lit(floor)).otherwise(F.round(ramp, 2)))


def query_thresholds(wanted: DataFrame, freq: DataFrame, base: float = 20.0, floor: float = 0.0) -> DataFrame:
    """``wanted``: (qid, term). Unknown terms count as frequency 0; the rarest term decides."""
    known = freq.groupBy("term").agg(F.max("freq_pct").alias("freq_pct"))
    rare = (wanted.withColumn("term", F.lower("term")).join(known, "term", "left")
            .groupBy("qid").agg(F.min(F.coalesce("freq_pct", F.lit(0.0))).alias("min_freq")))
    rare = rare.withColumn("min_freq", F.least("min_freq", F.lit(100.0)))
    return rare.withColumn("threshold", dynamic_threshold(F.col("min_freq"), base, floor))


def similar_places(place_terms: DataFrame, min_shared: int = 3) -> DataFrame:
    """Ordered place pairs sharing at least ``min_shared`` terms, with the count and the list.

    Pairs are counted over term *sets*: places with the very same set are folded to one signature first, so a
    term that every place has costs (distinct sets)², not (places)². Only the result is expanded to places.
    """
    sets = (place_terms.groupBy("place_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
            .filter(F.size("terms") >= min_shared).withColumn("sig", F.xxhash64("terms")))
    sig = sets.select("sig", "terms").distinct()
    # two sets share >= k terms iff they share one of their k-subsets' first elements: index by term, rarest first
    df = sig.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    ranked = (sig.select("sig", F.explode("terms").alias("term"), F.size("terms").alias("len")).join(df, "term")
              .withColumn("rk", F.row_number().over(W.partitionBy("sig").orderBy("df", "term"))))
    # prefix filter: with k shared terms, at least one is among the (len - k + 1) rarest of both sides
    prefix = ranked.filter(F.col("rk") <= F.col("len") - min_shared + 1).select("sig", "term")
    left = prefix.select(F.col("sig").alias("s1"), "term")
    right = prefix.select(F.col("sig").alias("s2"), "term")
    candidates = left.join(right, "term").filter("s1 <= s2").select("s1", "s2").distinct()
    at = lambda k: sig.select(F.col("sig").alias(f"s{k}"), F.col("terms").alias(f"t{k}"))
    shared = (candidates.join(at(1), "s1").join(at(2), "s2")
              .withColumn("shared", F.array_sort(F.array_intersect("t1", "t2")))
              .filter(F.size("shared") >= min_shared).select("s1", "s2", "shared"))
    has = lambda k, p: sets.select(F.col("sig").alias(k), F.col("place_id").alias(p))
    pairs = shared.join(has("s1", "a"), "s1").join(has("s2", "b"), "s2").filter("s1 <> s2 or a < b")
    return pairs.select(F.least("a", "b").alias("place_a"), F.greatest("a", "b").alias("place_b"),
                        F.size("shared").alias("n_shared"), F.array_join("shared", "|").alias("shared"))


def extraction_report(mentions: DataFrame, totals: DataFrame) -> DataFrame:
    """Long report: totals, sentiment counts, top 20 terms and places."""
    def block(df, section, n=None):
        out = df.select(F.lit(section).alias("section"), F.col("item").cast("string").alias("item"), F.col("n").cast("bigint").alias("n"))
        return out.orderBy(F.desc("n"), "item").limit(n) if n else out

    m = mentions
    one = m.agg(F.count("*").alias("triples"), F.countDistinct("place_id").alias("places"),
                F.countDistinct("term").alias("terms"), F.countDistinct("evidence_id").alias("reviews_with"))
    flat = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("n")) for c in one.columns])))
    per_term = m.groupBy(F.col("term").alias("item")).agg(F.count("*").alias("n"))
    per_place = m.groupBy(F.col("place_id").alias("item")).agg(F.count("*").alias("n"))
    per_sent = m.groupBy(F.col("sentiment").alias("item")).agg(F.count("*").alias("n"))
    return (block(flat, "total").unionByName(block(per_sent, "sentiment"))
            .unionByName(block(per_term, "top_term", 20)).unionByName(block(per_place, "top_place", 20)))


def evidence_documents(mentions: DataFrame, pop: DataFrame, chunk: int = 1000) -> DataFrame:
    """Evidence ids per (place, term) as JSON, in chunks of hash-even size, so no array grows without bound."""
    ids = mentions.select(*KEYS, "evidence_id").distinct()
    parts = pop.select(*KEYS, F.greatest(F.lit(1), F.ceil(F.col("review_count") / chunk)).cast("int").alias("parts"),
                       "pct", "review_count", "avg_confidence", "sentiment")
    return (ids.join(parts, KEYS)
            .withColumn("part", F.pmod(F.xxhash64("evidence_id"), F.col("parts").cast("bigint")))
            .groupBy(*KEYS, "part", "pct", "review_count", "avg_confidence", "sentiment")
            .agg(F.array_sort(F.collect_list("evidence_id")).alias("evidence_ids"))
            .select(*KEYS, "part", F.to_json(F.struct("pct", "review_count", "avg_confidence", "sentiment", "evidence_ids")).alias("document")))


def ranked_terms(pop: DataFrame, min_pct: float = 0.0) -> DataFrame:
    """One array per place and kind, largest share first; the array is bounded by the vocabulary."""
    item = F.struct((-F.round("pct", 1)).alias("neg"), F.col("term").alias("name"),
                    F.coalesce("sentiment", F.lit("neutral")).alias("sentiment"))
    rows = pop.filter(F.col("pct") >= min_pct)
    return rows.groupBy("kind", "place_id").agg(F.array_sort(F.collect_list(item)).alias("items")).withColumn(
        "items", F.transform("items", lambda x: F.struct(x["name"].alias("name"), (-x["neg"]).alias("pct"), x["sentiment"].alias("sentiment"))))
