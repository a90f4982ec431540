"""Views that stand for the engine's inputs over the given tables, as DataFrames and as SQL.

Every view covers its whole table. Roles are taken from column values (completed orders are past trips, open
orders are trip requests); nothing is sampled or cut.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from placelore.session import durable, spread, stored

TIME_TEXTS = [
    "Go early morning to avoid the heat", "The sunset here is magical in the evening",
    "Do not go in the afternoon because it is hot", "Best in the dry season from January to March",
    "Avoid weekends and public holidays", "Come on a weekday around 10 am", "At night the temple is lit up",
    "We visited during the monsoon in July", "November is a quiet shoulder season",
    "Arrive before 8 and climb early", "A late afternoon stroll was lovely", "Not suitable in the evening",
    "Poya day is special here", "The north-east monsoon brings rain in December",
    "A nice place for the family", "Never visit at noon as the sun is strong"]
CROWD_TEXTS = [
    "It was very crowded with tourists", "not overly crowded when we came", "There was a long queue at the gate",
    "It was quiet and peaceful", "We had the place to ourselves", "Some tourists but manageable",
    "lots of people everywhere", "no other visitors in sight", "Packed on the weekend",
    "Fewer tourists than expected", "The view is wide", "wasn't busy at all"]
COST_TEXTS = [
    "Entry fee is Rs. {a}", "{a} rupees for locals and {b} rupees for foreigners", "The ticket price was $ {c}",
    "Free entry, no entrance fee", "It is very expensive for what it is", "Not expensive and worth it",
    "cheap and great value", "Conservation fee of LKR {a} per person", "Guides ask for {c} usd",
    "the fee is reasonable", "We paid nothing special", "overpriced, not worth it"]
ACTIVITY_TEXTS = [
    "We went snorkelling and saw turtles near the reef", "The jeep safari was amazing",
    "Took a boat ride on the lagoon", "We hiked up the mountain and watched the sunrise",
    "The white water rafting was great fun", "Visited the old temple and the museum",
    "scuba diving lessons were too expensive", "Souvenir shopping was disappointing",
    "A scenic train ride through the hills", "Local food was not good",
    "The waterfall is dangerous and slippery", "We walked along the beach"]
PLACE_CATEGORIES = ["Beach", "Waterfall", "National Park", "Religious Site", "Viewpoint", "Botanical Garden",
                    "Shopping Mall", "Lake", "Museum", "Hot Springs", "Surf Bay", "Roundabout"]
INTENTS = ["activity_query", "feature_query", "facility_query", "place_attribute_query", "location_query",
           "comparison_query", "constraint_query", "explanation_query", "timing_query", "crowd_query",
           "cost_query", "nearby_query", "general_query"]
QUESTION_TEXTS = ["where can I find this", "which places are quiet and uncrowded", "cheap or free places",
                  "what is near here", "busy and lively spots", "what rating and percent does it have",
                  "best time to go"]


TERM_WORDS = ["STANDARD", "LARGE", "SMALL", "ECONOMY", "PROMO", "MEDIUM", "cruise"]
#: Synonyms, triggers and what they do, as data: (kind, word, term), (kind, trigger, term, instead), (trigger, avoid, min_pct).
SYNONYMS = [("activity", "cruise", "PROMO"), ("activity", "cruise", "ECONOMY"), ("trigger", "uncrowded", "uncrowded"), ("trigger", "cheap or free", "cheap")]
REWRITES = [("feature", "uncrowded", "Brand#11", "Brand#12"), ("feature", "uncrowded", "Brand#21", "Brand#22")]
AVOID = [("uncrowded", "Brand#1", 3.0), ("cheap", "Facility 3", 9.0)]


def _lit_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values: list[str], index):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


VIEW_SQL: dict[str, str] = {
    # -- reviews ------------------------------------------------------------------------------------
    "v_reviews": """
        select doc_id as review_id, source as place_key, text, lang, cast(n_chars as bigint) as n_chars,
               cast(1 + doc_id % 5 as bigint) as rating,
               case when doc_id % 11 = 0 then '' else 'u' || (doc_id - case when doc_id % 10 = 9 then 1 else 0 end) end as url,
               case when doc_id % 7 = 0 then null else 'user' || (doc_id % 50) end as user_name,
               case when doc_id % 3 = 0 then 'A' else 'B' end as src
        from documents""",
    "v_notes": f"""
        select l_orderkey * 100 + l_linenumber * 10 + (l_partkey % 10) as review_id, l_suppkey as place_id,
               1 + cast(l_quantity as bigint) % 5 as rating, cast(l_shipdate as date) as travel_date,
               l_partkey, l_discount,
               ({_lit_list(TIME_TEXTS)})[1 + (l_orderkey * 7 + l_partkey) % {len(TIME_TEXTS)}] || '. ' ||
               ({_lit_list(CROWD_TEXTS)})[1 + (l_orderkey + l_linenumber * 5) % {len(CROWD_TEXTS)}] || '. ' ||
               replace(replace(replace(
                 ({_lit_list(COST_TEXTS)})[1 + (l_partkey + l_linenumber) % {len(COST_TEXTS)}],
                 '{{a}}', cast(cast(floor(l_extendedprice / 100) as bigint) as varchar)),
                 '{{b}}', cast(cast(floor(l_extendedprice / 10) as bigint) as varchar)),
                 '{{c}}', cast(1 + cast(l_quantity as bigint) as varchar)) || '. ' ||
               ({_lit_list(ACTIVITY_TEXTS)})[1 + (l_partkey * 3 + l_orderkey) % {len(ACTIVITY_TEXTS)}] || '.' as text
        from lineitem""",
    # -- knowledge tables -----------------------------------------------------------------------------
    "v_places": f"""
        select s_suppkey as place_id, s_name as place_name, n_name as district, r_name as province,
               ({_lit_list(PLACE_CATEGORIES)})[1 + (s_suppkey * 5) % {len(PLACE_CATEGORIES)}] as category,
               5.9 + (s_suppkey * 37 % 400) / 100e0 as lat, 79.6 + (s_suppkey * 53 % 230) / 100e0 as lon,
               (s_suppkey * 7 % 51) / 10e0 as satisfaction, cast(100 * (s_suppkey % 60) as double) as cost,
               30 + s_suppkey * 13 % 150 as duration_min
        from supplier join nation on s_nationkey = n_nationkey
        left join region on n_regionkey = r_regionkey""",
    "v_mentions": """
        select unnest([{'kind': 'activity', 'term': p_type}, {'kind': 'feature', 'term': p_brand},
                       {'kind': 'facility', 'term': 'Facility ' || (p_size % 10)}], recursive := true),
               l_suppkey as place_id, l_orderkey as evidence_id,
               case l_returnflag when 'N' then 'positive' when 'R' then 'negative' else 'neutral' end as sentiment,
               100 - cast(round(l_discount * 100) as bigint) as conf_c
        from lineitem join part on l_partkey = p_partkey""",
    "v_totals": """
        select l_suppkey as place_id, count(distinct l_orderkey) as total_reviews from lineitem group by l_suppkey""",
    "v_pop": """
        select m.*, total_reviews,
               (2 * review_count * 10000 + total_reviews) // (2 * total_reviews) / 100 as pct,
               (2 * conf_sum * 100 + mentions) // (2 * mentions) / 10000 as avg_confidence,
               case when pos >= neg and pos >= neu then 'positive' when neg >= neu then 'negative' else 'neutral' end as sentiment
        from (select kind, place_id, term, count(*) as mentions, count(distinct evidence_id) as review_count,
                     cast(sum(conf_c) as bigint) as conf_sum,
                     count(*) filter (sentiment = 'positive') as pos, count(*) filter (sentiment = 'negative') as neg,
                     count(*) filter (sentiment = 'neutral') as neu
              from v_mentions group by kind, place_id, term) m
        join v_totals using (place_id)""",
    "v_has": """
        select kind, p.place_id, place_name, term, pop.sentiment, pct, review_count, district, province, category
        from v_pop pop join v_places p on pop.place_id = p.place_id""",
    "v_questions": f"""
        select conv_id * 100 + turn as qid,
               ({_lit_list(INTENTS)})[1 + (conv_id + turn) % {len(INTENTS)}] as intent,
               ({_lit_list(QUESTION_TEXTS)})[1 + (conv_id * 3 + turn) % {len(QUESTION_TEXTS)}] as question,
               ({_lit_list(TERM_WORDS)})[1 + (conv_id * 5 + turn) % 7] as activity,
               ({_lit_list(TERM_WORDS)})[1 + (conv_id * 5 + turn + 3) % 7] as second,
               'Brand#' || (1 + (conv_id * 7 + turn) % 27) as feature,
               'Facility ' || ((conv_id + turn) % 11) as facility,
               'Supplier#' || lpad(cast((conv_id * 37 + turn) % 120 as varchar), 9, '0') as place,
               case when conv_id % 4 = 0 then 'asia' when conv_id % 4 = 1 then 'nation_1' else '' end as location,
               5 + (conv_id + turn) % 8 as suggested, text
        from conversations where role = 'user'""",
    "v_asked": """
        select *, question || ': ' || activity || ' or ' || second || ', ' || feature || ' and (' || facility || ')' || case when qid % 5 = 0 then ' at ' || place else '' end
               || case when location <> '' then ' in ' || location || '?' else '' end as asked from v_questions""",
    "v_dictionary": f"""
        select distinct kind, lower(case kind when 'activity' then split_part(term, ' ', 1) else term end) as word, case kind when 'activity' then split_part(term, ' ', 1) else term end as term from v_pop
        union select 'place', lower(place_name), place_name from v_places union select 'location', lower(district), district from v_places union select 'location', lower(province), province from v_places where province is not null
        union select * from (values {", ".join(f"('{k}', '{w}', '{t}')" for k, w, t in SYNONYMS)})""",
    "v_matched": """
        with t as (select qid, ' ' || trim(regexp_replace(lower(asked), '[^\\pL\\pN#_]+', ' ', 'g')) || ' ' as t from v_asked),
        d as (select kind, term, ' ' || trim(regexp_replace(lower(word), '[^\\pL\\pN#_]+', ' ', 'g')) || ' ' as w from v_dictionary)
        select qid, kind, term from (select *, row_number() over (partition by qid, kind order by pos, term) as nth from (
          select qid, kind, term, min(instr(t, w)) as pos from t join d on contains(t, w) group by qid, kind, term)) where nth <= 5""",
    "v_terms": f"""
        select distinct m.qid, m.kind, coalesce(r.instead, m.term) as term from v_matched m left join (select qid, r.kind, r.term, min(r.instead) as instead
          from v_matched m join (values {", ".join(str(x) for x in REWRITES)}) as r(kind, trigger, term, instead) on m.kind = 'trigger' and m.term = r.trigger group by all) r on r.qid = m.qid and r.kind = m.kind and r.term = m.term""",
    "v_avoided": f"""
        select distinct m.qid, h.place_id from v_matched m join (values {", ".join(str(x) for x in AVOID)}) as r(trigger, avoid, min_pct) on m.kind = 'trigger' and m.term = r.trigger
        join v_has h on h.sentiment = 'negative' and contains(lower(h.term), lower(r.avoid)) and h.pct > r.min_pct""",
    # -- trips ------------------------------------------------------------------------------------------
    "v_visits": """
        select l_orderkey as trip_id, l_suppkey as place_id,
               row_number() over (partition by l_orderkey order by min(l_linenumber), l_suppkey) as pos
        from lineitem group by l_orderkey, l_suppkey""",
    "v_trips": """
        select trip_id, place_id, pos from v_visits join orders on trip_id = o_orderkey where o_orderstatus = 'F'""",
    "v_req_stops": """
        select trip_id as req_id, place_id, pos, o_totalprice
        from v_visits join orders on trip_id = o_orderkey where o_orderstatus <> 'F'""",
    "v_budget": """
        select o_orderkey as req_id, case when o_totalprice < 150000 then 480 when o_totalprice < 300000 then 960 else 1800 end * 1000000 as budget
        from orders where o_orderstatus <> 'F'""",
    "v_legs": """
        select x.req_id, x.pos - 1 as i, y.pos - 1 as j, cast(round(travel_time_min * 1000000) as bigint) as t, cast(round(distance_km * 1000000) as bigint) as d
        from v_req_stops x join v_req_stops y on x.req_id = y.req_id and x.pos <> y.pos join v_roads r on r.a = x.place_id and r.b = y.place_id""",
    "v_stops": """
        select req_id, pos - 1 as i, s.place_id, duration_min * 1000000 as dur, cost, satisfaction as sat, count(*) over (partition by req_id) as n
        from v_req_stops s join v_places p on s.place_id = p.place_id""",
    "v_nn_step": """
        select req_id, n, 0 as k, 0 as cur, [0] as ord, 0::bigint as last_t, 0::bigint as last_d from v_stops where i = 0""",
    "v_edges": """
        select a, b, km as distance_km, round(1.6 * km, 6) as travel_time_min
        from (select a, b, round(1.2 * 2 * 6371 * atan2(sqrt(h), sqrt(1 - h)), 6) as km
              from (select a, b, pow(sin(radians(pb.lat - pa.lat) / 2), 2)
                           + cos(radians(pa.lat)) * cos(radians(pb.lat)) * pow(sin(radians(pb.lon - pa.lon) / 2), 2) as h
                    from (select distinct x.place_id as a, y.place_id as b
                          from v_visits x join v_visits y on x.trip_id = y.trip_id and y.pos = x.pos + 1)
                    join v_places pa on a = pa.place_id join v_places pb on b = pb.place_id))
        where km > 0""",
    "v_roads": """
        select a, b, distance_km, travel_time_min from v_edges
        union all
        select e.b, e.a, e.distance_km, e.travel_time_min from v_edges e
        where not exists (select 1 from v_edges f where f.a = e.b and f.b = e.a)""",
}


def notes_of(lines: DataFrame) -> DataFrame:
    """Reviews made of order lines, row by row: works on a table and on a stream."""
    o, p, ln = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    price, qty = F.col("l_extendedprice"), F.col("l_quantity").cast("bigint")
    cost = _pick(COST_TEXTS, (p + ln) % len(COST_TEXTS))
    for mark, value in (("{a}", F.floor(price / 100)), ("{b}", F.floor(price / 10)), ("{c}", 1 + qty)):
        cost = F.replace(cost, F.lit(mark), value.cast("bigint").cast("string"))
    text = F.concat(_pick(TIME_TEXTS, (o * 7 + p) % len(TIME_TEXTS)), F.lit(". "),
                    _pick(CROWD_TEXTS, (o + ln * 5) % len(CROWD_TEXTS)), F.lit(". "), cost, F.lit(". "),
                    _pick(ACTIVITY_TEXTS, (p * 3 + o) % len(ACTIVITY_TEXTS)), F.lit("."))
    return lines.select(
        (o * 100 + ln * 10 + p % 10).alias("review_id"), F.col("l_suppkey").alias("place_id"),
        (1 + qty % 5).alias("rating"), F.col("l_shipdate").cast("date").alias("travel_date"),
        "l_partkey", "l_discount", text.alias("text"))


class Views:
    """Lazy DataFrames for one scale directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        """Long texts: the per-row work is heavy, so a small file is spread over the cores."""
        return spread(self.table("documents"))

    @cached_property
    def reviews(self) -> DataFrame:
        i = F.col("doc_id")
        return self.documents.select(
            i.alias("review_id"), F.col("source").alias("place_key"), "text", "lang", "n_chars",
            (1 + i % 5).alias("rating"),
            F.when(i % 11 == 0, "").otherwise(
                F.concat(F.lit("u"), (i - F.when(i % 10 == 9, 1).otherwise(0)).cast("string"))).alias("url"),
            F.when(i % 7 != 0, F.concat(F.lit("user"), (i % 50).cast("string"))).alias("user_name"),
            F.when(i % 3 == 0, "A").otherwise("B").alias("src"))

    @cached_property
    def notes(self) -> DataFrame:
        columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"]
        return notes_of(spread(self.table("lineitem").select(*columns)))

    @cached_property
    def places(self) -> DataFrame:
        s = F.col("s_suppkey")
        small = lambda n: F.broadcast(self.table(n))  # noqa: E731  (5 regions, 25 nations: fixed tables)
        return (self.table("supplier").join(small("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
                .join(small("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
                .select(s.alias("place_id"), F.col("s_name").alias("place_name"), F.col("n_name").alias("district"),
                        F.col("r_name").alias("province"),
                        _pick(PLACE_CATEGORIES, s * 5 % len(PLACE_CATEGORIES)).alias("category"),
                        (5.9 + (s * 37 % 400) / 100).alias("lat"), (79.6 + (s * 53 % 230) / 100).alias("lon"),
                        ((s * 7 % 51) / 10).alias("satisfaction"), (100 * (s % 60)).cast("double").alias("cost"),
                        (30 + s * 13 % 150).alias("duration_min")))

    @cached_property
    def mentions(self) -> DataFrame:
        kinds = F.array(
            F.struct(F.lit("activity").alias("kind"), F.col("p_type").alias("term")),
            F.struct(F.lit("feature").alias("kind"), F.col("p_brand").alias("term")),
            F.struct(F.lit("facility").alias("kind"), F.concat(F.lit("Facility "), (F.col("p_size") % 10).cast("string")).alias("term")))
        return (self.table("lineitem").join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
                .select(F.inline(kinds), F.col("l_suppkey").alias("place_id"), F.col("l_orderkey").alias("evidence_id"),
                        F.when(F.col("l_returnflag") == "N", "positive").when(F.col("l_returnflag") == "R", "negative")
                        .otherwise("neutral").alias("sentiment"),
                        (100 - F.round(F.col("l_discount") * 100).cast("bigint")).alias("conf_c")))

    @cached_property
    def totals(self) -> DataFrame:
        return (self.table("lineitem").groupBy(F.col("l_suppkey").alias("place_id"))
                .agg(F.countDistinct("l_orderkey").alias("total_reviews")))

    @cached_property
    def pop(self) -> DataFrame:
        from placelore.operators.triples import popularity

        return stored(popularity(self.mentions, self.totals))

    @cached_property
    def has(self) -> DataFrame:
        p = self.places.select("place_id", "place_name", "district", "province", "category")
        return self.pop.select("kind", "place_id", "term", "sentiment", "pct", "review_count").join(p, "place_id")

    @cached_property
    def questions(self) -> DataFrame:
        c, t = F.col("conv_id"), F.col("turn")
        return self.table("conversations").filter(F.col("role") == "user").select(
            (c * 100 + t).alias("qid"), _pick(INTENTS, (c + t) % len(INTENTS)).alias("intent"),
            _pick(QUESTION_TEXTS, (c * 3 + t) % len(QUESTION_TEXTS)).alias("question"),
            _pick(TERM_WORDS, (c * 5 + t) % 7).alias("activity"), _pick(TERM_WORDS, (c * 5 + t + 3) % 7).alias("second"),
            F.concat(F.lit("Brand#"), (1 + (c * 7 + t) % 27).cast("string")).alias("feature"),
            F.concat(F.lit("Facility "), ((c + t) % 11).cast("string")).alias("facility"),
            F.concat(F.lit("Supplier#"), F.lpad(((c * 37 + t) % 120).cast("string"), 9, "0")).alias("place"),
            F.when(c % 4 == 0, "asia").when(c % 4 == 1, "nation_1").otherwise("").alias("location"),
            (5 + (c + t) % 8).alias("suggested"), "text")

    @cached_property
    def asked(self) -> DataFrame:
        """Questions with a whole text that names terms of several kinds, some places and some areas."""
        part = lambda when, *x: F.when(when, F.concat(*x)).otherwise("")
        c, l = F.col, F.lit
        text = F.concat("question", l(": "), "activity", l(" or "), "second", l(", "), "feature", l(" and ("), "facility", l(")"),
                        part(c("qid") % 5 == 0, l(" at "), c("place")), part(c("location") != "", l(" in "), c("location"), l("?")))
        return self.questions.withColumn("asked", text)

    @cached_property
    def dictionary(self) -> DataFrame:
        term = F.when(F.col("kind") == "activity", F.split_part("term", F.lit(" "), F.lit(1))).otherwise(F.col("term"))
        own = self.pop.select("kind", F.lower(term).alias("word"), term.alias("term"))
        name = lambda kind, c: self.places.filter(F.col(c).isNotNull()).select(F.lit(kind).alias("kind"), F.lower(c).alias("word"), F.col(c).alias("term"))
        return own.union(name("place", "place_name")).union(name("location", "district")).union(name("location", "province")).union(
            self.spark.createDataFrame(SYNONYMS, "kind string, word string, term string")).distinct()

    @cached_property
    def matched(self) -> DataFrame:
        from placelore.operators.questions import match_terms

        return durable(match_terms(self.asked, self.dictionary))

    @cached_property
    def terms(self) -> DataFrame:
        from placelore.operators.questions import rewritten

        return rewritten(self.matched, self.spark.createDataFrame(REWRITES, "kind string, trigger string, term string, instead string"))

    @cached_property
    def avoided(self):
        from placelore.operators.questions import avoided_places

        return avoided_places(self.matched, self.has, self.spark.createDataFrame(AVOID, "trigger string, avoid string, min_pct double"))

    @cached_property
    def visits(self) -> DataFrame:
        first = self.table("lineitem").groupBy(F.col("l_orderkey").alias("trip_id"), F.col("l_suppkey").alias("place_id")).agg(
            F.min("l_linenumber").alias("line"))
        w = W.partitionBy("trip_id").orderBy("line", "place_id")
        return first.select("trip_id", "place_id", F.row_number().over(w).alias("pos"))

    def _orders(self):
        return self.table("orders").select(F.col("o_orderkey").alias("trip_id"), "o_orderstatus", "o_totalprice")

    @cached_property
    def trips(self) -> DataFrame:
        done = self._orders().filter(F.col("o_orderstatus") == "F").select("trip_id")
        return self.visits.join(done, "trip_id")

    @cached_property
    def req_stops(self) -> DataFrame:
        still_open = self._orders().filter(F.col("o_orderstatus") != "F").select("trip_id", "o_totalprice")
        return self.visits.join(still_open, "trip_id").withColumnRenamed("trip_id", "req_id")

    @cached_property
    def requests(self) -> DataFrame:
        """One row per open order: stops, leg matrices and a time budget (micro-minutes) by price band.

        Stored: the compact rows feed long per-row expressions and are read several times.
        """
        from placelore.operators.trips import requests

        price = F.col("o_totalprice")
        budget = (F.when(price < 150000, 480).when(price < 300000, 960).otherwise(1800) * 1_000_000).cast("bigint")
        return stored(requests(self.req_stops.withColumn("budget", budget).drop("o_totalprice"), self.places, self.roads, ["budget"]))

    @cached_property
    def edges(self) -> DataFrame:
        from placelore.functions.geo import haversine_km

        w = W.partitionBy("trip_id").orderBy("pos")
        pairs = (self.visits.select(F.col("place_id").alias("a"), F.lead("place_id").over(w).alias("b"))
                 .filter(F.col("b").isNotNull()).distinct())
        at = lambda k: self.places.select(F.col("place_id").alias(k), F.col("lat").alias(f"lat_{k}"), F.col("lon").alias(f"lon_{k}"))
        km = F.round(1.2 * haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")), 6)
        return (pairs.join(at("a"), "a").join(at("b"), "b").select("a", "b", km.alias("distance_km"))
                .filter("distance_km > 0")
                .withColumn("travel_time_min", F.round(1.6 * F.col("distance_km"), 6)))

    @cached_property
    def roads(self) -> DataFrame:
        from placelore.operators.trips import two_way

        return two_way(self.edges)
