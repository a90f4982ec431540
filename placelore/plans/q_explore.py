"""Registered queries for browsing, profile questions and weather."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from placelore.functions import explore as FX
from placelore.functions import rules as R
from placelore.functions import text as T
from placelore.operators import explore as X
from placelore.operators import trips as P
from placelore.operators import weather as WX
from placelore.plans.registry import query
from placelore.plans.sqltext import lit, lit_list
from placelore.sources import proxies
from placelore.sources.proxies import VIEW_SQL, _pick

_TODS, _SEAS = ["EARLY_MORNING", "MID_MORNING", "AFTERNOON", "EVENING", "NIGHT", ""], ["DRY_SEASON", "MONSOON", ""]
_COST = ["FREE", "LOW", "MODERATE", "HIGH", "VERY_HIGH", ""]
VIEW_SQL["v_ugc"] = f"""
 select p.*, nullif(({lit_list(_TODS)})[1 + p.place_id % 6], '') as time_of_day, nullif(({lit_list(_SEAS)})[1 + p.place_id % 3], '') as season, (['MAY', 'MAY,JUNE,JULY,AUGUST', '', ''])[1 + p.place_id % 4] as months,
  (['WEEKEND', ''])[1 + p.place_id % 2] as avoid, case when p.place_id % 7 <> 0 then 1 + p.place_id * 3 % 5 end as crowd_level, nullif(({lit_list(_COST)})[1 + p.place_id * 5 % 6], '') as cost_level,
  case when p.place_id % 5 <> 0 then 100 * (p.place_id % 50) end as median_lkr, (p.place_id * 13 % 100) / 100e0 as conf, coalesce(total_reviews, 0) as total_reviews
 from v_places p left join v_totals t on p.place_id = t.place_id"""
VIEW_SQL["v_ugc2"] = f"""select *, (['EMPTY', 'QUIET', 'MODERATE', 'BUSY', 'PACKED'])[crowd_level] as crowd_label,
 case {" ".join("when " + " or ".join(f"contains(lower(category), '{m}')" for m in ms) + f" then '{k}'" for k, ms in R.THEMES)} else 'other' end as theme,
 case when lat >= 8.55 then 'Northern' when lon >= 81.30 and lat >= 6.60 then 'East Coast' when lat >= 7.55 and lat < 8.55 and lon < 81.30 then 'Cultural Triangle' when lat >= 6.55 and lat < 7.55 and lon >= 80.35 and lon < 81.30 then 'Hill Country'
  when lat >= 6.60 and lon < 80.35 then 'West Coast' when lat < 6.60 then 'South Coast' else 'Sri Lanka' end as region,
 (case when satisfaction > 0 then satisfaction / 5 else 0.62e0 end) * 0.55e0 + least(1e0, log10(1 + total_reviews) / 2.7e0) * 0.25e0
  + ((case when time_of_day is null then 0 else 1 end) + (case when crowd_level is null then 0 else 1 end) + (case when cost_level is null then 0 else 1 end)) / 3 * 0.20e0 as quality from v_ugc"""
VIEW_SQL["v_match"] = "select *, cast(greatest(38, least(99, floor((quality * 0.6e0 + 0.72e0 * 0.4e0) * 100 + 0.5e0))) as bigint) as match from v_ugc2"


def ugc(v):
    p = v.places.join(v.totals, "place_id", "left").withColumn("total_reviews", F.coalesce("total_reviews", F.lit(0)))
    i, none = F.col("place_id"), F.lit("")
    p = p.withColumns({
        "time_of_day": F.nullif(_pick(_TODS, i % 6), none), "season": F.nullif(_pick(_SEAS, i % 3), none),
        "months": _pick(["MAY", "MAY,JUNE,JULY,AUGUST", "", ""], i % 4), "avoid": _pick(["WEEKEND", ""], i % 2),
        "crowd_level": F.when(i % 7 != 0, 1 + i * 3 % 5), "cost_level": F.nullif(_pick(_COST, i * 5 % 6), none),
        "median_lkr": F.when(i % 5 != 0, 100 * (i % 50)), "conf": (i * 13 % 100) / 100, "name": F.col("place_name"), "rating": F.col("satisfaction")})
    from placelore.functions.geo import region

    p = p.withColumns({"crowd_label": F.get(F.array(*[F.lit(R.CROWD_LABEL[k]) for k in range(1, 6)]), (F.col("crowd_level") - 1).cast("int")),
                       "theme": FX.theme(F.col("category")), "region": region(F.col("lat"), F.col("lon"))})
    aspects = sum((F.col(c).isNotNull().cast("int") for c in ("time_of_day", "crowd_level", "cost_level")), F.lit(0))
    p = p.withColumn("quality", FX.quality(F.col("rating"), F.col("total_reviews"), aspects))
    return p.withColumn("match", FX.match_score(F.col("quality")))


proxies.Views.ugc = property(ugc)
arr = lambda c: F.filter(F.split(F.col(c), ","), lambda x: x != "")
cols = lambda df: {c: F.col(c) for c in df.columns}


@query("m23_match_score", "select place_id, match, round(quality, 6) as quality, cast(greatest(38, least(99, floor((quality * 0.6e0 + ((case when theme = 'beach' then 1 else 0 end) + (case when region = 'Hill Country' then 1 else 0 end) + (case when satisfaction >= 3 then 1 else 0 end)) / 3 * 0.4e0) * 100 + 0.5e0))) as bigint) as with_prefs from v_match")
def m23(v):
    met = (F.col("theme") == "beach").cast("int") + (F.col("region") == "Hill Country").cast("int") + (F.col("rating") >= 3).cast("int")
    return v.ugc.select("place_id", "match", F.round("quality", 6).alias("quality"), FX.match_score(F.col("quality"), met, F.lit(3)).alias("with_prefs"))


@query("f8_explore_filter", """select place_id from v_match where theme in ('beach', 'water', 'heritage', 'wildlife') and satisfaction >= 1 and cost <= 4000 and duration_min <= 170 and contains(lower(concat_ws(' ', place_name, category, region, 'PROMO SMALL')), 'coast')
 and crowd_level is not null""")
def f8(v):
    u = v.ugc.withColumn("activities", F.array(F.lit("PROMO"), F.lit("SMALL")))
    c = X.conjunction(cols(u), themes=("beach", "water", "heritage", "wildlife"), activities=("PROMO", "SMALL"), min_rating=1, max_cost=4000, max_duration=170, search=" Coast ")
    return u.filter(c & F.col("crowd_level").isNotNull()).select("place_id")


_INS = {"time:EARLY_MORNING": "time_of_day = 'EARLY_MORNING'", "time:AFTERNOON": "time_of_day = 'AFTERNOON'", "time:EVENING": "time_of_day = 'EVENING'", "crowd:quiet": "crowd_label in ('EMPTY', 'QUIET')", "crowd:packed": "crowd_label in ('BUSY', 'PACKED')",
        "cost:free": "cost_level = 'FREE'", "cost:cheap": "cost_level in ('FREE', 'LOW')", "season:DRY_SEASON": "season = 'DRY_SEASON'", "has:photo": "cost > 100"}


@query("f9_insight_predicates", "select district, " + ", ".join(f"count(*) filter ({c}) as n_{k.replace(':', '_').lower()}" for k, c in _INS.items()) + " from v_match group by district")
def f9(v):
    u = v.ugc.withColumn("image", F.when(F.col("cost") > 100, "x.jpg"))
    return u.groupBy("district").agg(*[F.count_if(FX.INSIGHTS[k](cols(u))).alias(f"n_{k.replace(':', '_').lower()}") for k in _INS])


@query("k3_sort_orders", " union all ".join(f"select '{o}' as ord, place_id, row_number() over (order by {k}place_name) as rank from v_match" for o, k in (("match", "match desc, "), ("rating", "satisfaction desc, "), ("popular", "total_reviews desc, "), ("price", "cost, "), ("name", ""))))
def k3(v):
    from placelore.session import union_all

    u = v.ugc
    # a rank over the place dimension is the product here: the whole list in one order
    return union_all([u.select(F.lit(o).alias("ord"), "place_id", F.row_number().over(W.partitionBy(F.lit(o)).orderBy(*X.sort_keys(o))).cast("bigint").alias("rank")) for o in ("match", "rating", "popular", "price", "name")])


@query("k4_home_lists", """(select 'popular' as list, place_id from v_match order by total_reviews desc, place_name limit 4) union all (select 'recommended', place_id from v_match where time_of_day is not null order by match desc, place_name limit 4)
 union all (select 'trending', place_id from v_match where satisfaction > 0 and total_reviews >= 40 order by satisfaction desc, total_reviews desc, place_name limit 4)""")
def k4(v):
    u = v.ugc
    top = lambda name, df, *k: df.orderBy(*k, "place_name").limit(4).select(F.lit(name).alias("list"), "place_id")
    return (top("popular", u, F.desc("total_reviews")).unionByName(top("recommended", u.filter("time_of_day is not null"), F.desc("match")))
            .unionByName(top("trending", u.filter("rating > 0 and total_reviews >= 40"), F.desc("rating"), F.desc("total_reviews"))))


@query("k5_quotes", """with s as (select source as place_key, 1 + doc_id % 5 as rating, regexp_replace(x, '^\\s+|\\s+$', '', 'g') as text from (select doc_id, source, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) as x from documents)),
 o as (select *, row_number() over (partition by place_key order by length(text) desc, text) as rn from s where length(text) > 70 and length(text) < 190 and rating >= 4)
select place_key, rating, text from o where rn = 1 order by length(text) desc, text, place_key limit 3""")
def k5(v):
    s = v.documents.select(F.col("source").alias("place_key"), (1 + F.col("doc_id") % 5).alias("rating"), F.explode(T.sentences(F.col("text"))).alias("text"))
    return X.quotes(s).select("place_key", "rating", "text")


@query("k6_similar_places", """with p as (select a.place_id, b.place_id as other, b.place_name, b.match, (case when a.theme = b.theme then 3 else 0 end) + (case when a.region = b.region then 2 else 0 end) + (case when a.time_of_day = b.time_of_day then 1 else 0 end) as affinity from v_match a join v_match b on a.place_id <> b.place_id)
select place_id, other, affinity, rank from (select *, row_number() over (partition by place_id order by affinity desc, match desc, place_name) as rank from p where affinity > 0) where rank <= 3""")
def k6(v):
    return X.similar(v.ugc).select("place_id", "other", F.col("affinity").cast("bigint").alias("affinity"), F.col("rank").cast("bigint").alias("rank"))


@query("k11_poi_list", "select place_id, place_name || ' (' || category || ')' as label, place_name = (select coalesce(max(place_name) filter (place_name = 'Supplier#000000007'), min(place_name)) from v_places) as is_default from v_places")
def k11(v):
    p = v.places.withColumn("k", F.lit(1))
    d = p.groupBy("k").agg(F.coalesce(F.max(F.when(F.col("place_name") == "Supplier#000000007", F.col("place_name"))), F.min("place_name")).alias("d"))
    return p.join(d, "k").select("place_id", P.place_label(F.col("place_name"), F.col("category")).alias("label"), (F.col("place_name") == F.col("d")).alias("is_default")).orderBy("label")


@query("m24_place_value", "select place_id, round(0.25e0 * satisfaction * 10 + 0.15e0 * (1 / (1 + cost / 1000)), 6) as value, round(satisfaction / greatest(duration_min, 1), 6) as density from v_places")
def m24(v):
    w = P.normalize_weights({"attraction": 25, "budget": 15, "time": 45, "popular": 15})
    return v.places.select("place_id", F.round(w["attraction"] * F.col("satisfaction") * 10 + w["budget"] * (1 / (1 + F.col("cost") / 1000)), 6).alias("value"),
                           F.round(F.col("satisfaction") / F.greatest("duration_min", F.lit(1)), 6).alias("density"))


def _title(e):
    return f"(upper(replace(lower({e}), '_', ' ')[1:1]) || replace(lower({e}), '_', ' ')[2:])"


_DUR = "case when duration_min < 60 then duration_min || 'm' when duration_min % 60 = 0 then (duration_min // 60) || 'h' else (duration_min // 60) || 'h ' || (duration_min % 60) || 'm' end"


@query("t24_display_texts", f"""select place_id, {_DUR} as duration, coalesce(case cost_level {" ".join(f"when {lit(k)} then {lit(x)}" for k, x in R.COST_PRICE.items())} end, case when cost > 0 then '$$' else 'Free' end) as price,
 coalesce(case when months <> '' then array_to_string(string_split(months, ',')[1:3], ', ') end, {_title('season')}, {_title('time_of_day')}) as season_text from v_match""")
def t24(v):
    return v.ugc.select("place_id", FX.duration_text(F.col("duration_min")).alias("duration"), FX.price_text(F.col("cost_level"), F.col("cost")).alias("price"),
                        FX.season_text(arr("months"), F.col("season"), F.col("time_of_day")).alias("season_text"))


@query("t28_travel_tips", f"""select place_id, array_to_string(list_filter([case when time_of_day is not null then 'go in the ' || lower({_title('time_of_day')}) end, case when avoid <> '' then 'skip ' || lower(avoid) end,
 case when months <> '' then 'in season: ' || replace(months, ',', ', ') end, case when crowd_label in ('BUSY', 'PACKED') then 'often crowded' end,
 case when cost_level = 'FREE' and coalesce(median_lkr, 0) = 0 then 'no fee' when median_lkr > 0 then median_lkr || ' LKR each' end, {_DUR} || ' on site'], lambda x: x is not null)[1:5], ' ') as tips from v_match""")
def t28(v):
    u = v.ugc.withColumns({"months": arr("months"), "avoid": arr("avoid")})
    return u.select("place_id", F.array_join(FX.tips(cols(u)), " ").alias("tips"))


@query("t33_fact_cards", f"""select place_id, coalesce({_title('time_of_day')}, {_title('season')}, 'See reviews') as time_head, concat_ws(' · ', nullif(replace(months, ',', ', '), ''), {_title('season')}, 'avoid ' || lower(nullif(avoid, ''))) as time_detail,
 case crowd_label {" ".join(f"when {lit(k)} then {lit(x)}" for k, x in R.CROWD_TEXT.items())} end as crowd_head, case cost_level {" ".join(f"when {lit(k)} then {lit(x)}" for k, x in R.COST_TEXT.items())} end as cost_head,
 cast(floor(conf * 100 + 0.5) as bigint) || '% confidence · ' || total_reviews || ' mentions' as confidence from v_match""")
def t33(v):
    return v.ugc.select("place_id", F.coalesce(FX.title_case(F.col("time_of_day")), FX.title_case(F.col("season")), F.lit("See reviews")).alias("time_head"),
                        F.concat_ws(" · ", F.nullif(F.array_join(arr("months"), ", "), F.lit("")), FX.title_case(F.col("season")), F.concat(F.lit("avoid "), F.lower(F.nullif(F.col("avoid"), F.lit(""))))).alias("time_detail"),
                        FX.lookup(R.CROWD_TEXT, F.col("crowd_label")).alias("crowd_head"), FX.lookup(R.COST_TEXT, F.col("cost_level")).alias("cost_head"),
                        F.concat(F.floor(F.col("conf") * 100 + 0.5).cast("string"), F.lit("% confidence · "), F.col("total_reviews").cast("string"), F.lit(" mentions")).alias("confidence"))


@query("j4_explore_merge", """
with p as (select place_name as name, category, lat, lon from v_match where satisfaction > 1), u as (select upper(replace(place_name, '#', ' # ')) as place_name, time_of_day, total_reviews from v_match where crowd_level is not null),
 w as (select place_name as poi_name, case when cost > 500 then cast(lat as varchar) else 'n/a' end as latitude, cast(lon as varchar) as longitude from v_match where cost > 0), k as (select regexp_replace(lower(name), '[^a-z0-9]', '', 'g') as k, * from p), ku as (select regexp_replace(lower(place_name), '[^a-z0-9]', '', 'g') as k, * from u), kw as (select regexp_replace(lower(poi_name), '[^a-z0-9]', '', 'g') as k, * from w)
select regexp_replace(lower(coalesce(name, trim(regexp_replace(place_name, '\\s+', ' ', 'g')))), '[^a-z0-9]+', '-', 'g') as id, coalesce(category, 'Encyclopedic') as category, time_of_day, total_reviews, round(case when lat is null then try_cast(latitude as double) else lat end, 4) as lat, items
from (select coalesce(k.k, ku.k) as kk, * from k full join ku on k.k = ku.k) m left join kw on kw.k = m.kk left join (select regexp_replace(lower(place_name), '[^a-z0-9]', '', 'g') as k, string_agg(term, ', ' order by term) as items from v_has where kind = 'activity' group by 1) t on t.k = m.kk""")
def j4(v):
    u = v.ugc
    pois = u.filter("rating > 1").select("name", "category", "lat", "lon")
    prof = u.filter("crowd_level is not null").select(F.upper(F.replace("place_name", F.lit("#"), F.lit(" # "))).alias("place_name"), "time_of_day", "total_reviews")
    wiki = u.filter("cost > 0").select(F.col("place_name").alias("poi_name"), F.when(F.col("cost") > 500, F.col("lat").cast("string")).otherwise("n/a").alias("latitude"), F.col("lon").cast("string").alias("longitude"),
                                       F.lit("Encyclopedic").alias("wiki_category"), F.lit("").alias("rag_text"))
    terms = v.has.filter("kind = 'activity'").groupBy("place_name").agg(F.array_join(F.array_sort(F.collect_set("term")), ", ").alias("items"))
    m = X.merge_places(pois, prof, wiki, {"activities": terms})
    cat = F.when(F.col("category") == "Attraction", "Encyclopedic").otherwise(F.col("category"))
    return m.select("id", cat.alias("category"), "time_of_day", "total_reviews", F.round("lat", 4).alias("lat"), F.col("activities").alias("items"))


@query("a40_s17_home_statistics", """select 'places' as item, count(*) as n from v_match union all select 'reviews', cast(sum(total_reviews) as bigint) from v_match union all select 'with_best_time', count(*) from v_match where time_of_day is not null
 union all select 'with_crowd', count(*) from v_match where crowd_level is not null union all select 'with_cost', count(*) from v_match where cost_level is not null union all select 'theme:' || theme, count(*) from v_match group by theme
 union all (select 'activity:' || term, count(distinct place_id) as n from v_has where pct >= 15 group by term order by n desc, term limit 10)""")
def a40(v):
    u = v.ugc
    c = X.counts_block(u)
    head = c.select(F.inline(F.array(*[F.struct(F.lit(k).alias("item"), F.col(k).alias("n")) for k in c.columns])))
    themes = u.groupBy(F.concat(F.lit("theme:"), "theme").alias("item")).agg(F.count("*").alias("n"))
    acts = v.has.filter("pct >= 15").groupBy("term").agg(F.countDistinct("place_id").alias("n")).orderBy(F.desc("n"), "term").limit(10)
    return head.unionByName(themes).unionByName(acts.select(F.concat(F.lit("activity:"), "term").alias("item"), "n"))


_Q = "q.qid, p.place_name, p.district"


def _profile_sql(value, order, place_ok, loc_ok, all_ok, asked="true"):
    return f"""with h as (select {_Q}, {value}, case when contains(lower(p.place_name), lower(q.place)) then 1 when q.location <> '' and contains(lower(p.district), lower(q.location)) and {loc_ok} then 2 when q.location = '' and {all_ok} then 3 end as tier, {order} as o, q.suggested from v_questions q join v_match p on {place_ok} where {asked}),
 b as (select *, min(tier) over (partition by qid) as best from h where tier is not null)
select qid, place_name, district, value, tier from (select *, row_number() over (partition by qid order by o, place_name) as rn from b where tier = best) where rn <= least(suggested, 10)"""


def _profile_query(v, value, place_ok, loc_ok, all_ok, order, asked=None):
    """By named place; else by location; else over all places. Each tier is ranked per place, location or once."""
    from placelore.operators import graphq as G

    u = v.ugc.filter(place_ok)
    q = (v.questions if asked is None else v.questions.filter(asked)).select("qid", "place", "location", "suggested")
    cols_ = ["place_id", "place_name", "district", value.alias("value"), order.alias("o")]
    hit = G.contains_join(q.select("place").distinct(), "place", v.places.select("place_id", "place_name"), "place_name").select("place", "place_id")
    by_place = q.join(hit, "place").join(u.select(*cols_), "place_id").withColumn("tier", F.lit(1))
    left = q.join(by_place.select("qid").distinct(), "qid", "left_anti")
    area = G.contains_join(q.select("location").distinct(), "location", v.places.select("district").distinct(), "district").select("location", "district")
    by_loc = left.join(area, "location").join(u.filter(loc_ok).select(*cols_), "district").withColumn("tier", F.lit(2))
    top = u.filter(all_ok).select(*cols_).orderBy("o", "place_name").limit(10).withColumn("location", F.lit(""))
    by_all = left.join(F.broadcast(top), "location").withColumn("tier", F.lit(3))  # ten rows
    keep = ["qid", "place_name", "district", "value", "o", "tier", "suggested"]
    w = W.partitionBy("qid").orderBy("o", "place_name")
    every = by_place.select(*keep).unionByName(by_loc.select(*keep)).unionByName(by_all.select(*keep)).withColumn("rn", F.row_number().over(w)).filter("rn <= 10")
    return every.filter(F.col("rn") <= F.col("suggested")).select("qid", "place_name", "district", "value", "tier")


@query("q11_timing", _profile_sql("time_of_day as value", "-conf", "time_of_day is not null", "conf >= 0.5", "conf >= 0.7"))
def q11(v):
    return _profile_query(v, F.col("time_of_day"), F.col("time_of_day").isNotNull(), F.col("conf") >= 0.5, F.col("conf") >= 0.7, -F.col("conf"))


def _any_word(words):
    """A question holds one of the words, as SQL."""
    return "(" + " or ".join(f"contains(lower(question), {lit(w)})" for w in words) + ")"


def _holds(words):
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower("question"), w))


_BUSY_SQL = f"({_any_word(R.BUSY_WORDS)} and not {_any_word(R.QUIET_WORDS)})"


def _two(*parts):
    return " union all ".join(f"(select * from ({p}))" for p in parts)


@query("q12_crowd", _two(_profile_sql("crowd_label as value", "crowd_level", "crowd_level is not null", "crowd_level <= 2", "crowd_level <= 2 and conf >= 0.5", f"not {_BUSY_SQL}"),
                         _profile_sql("crowd_label as value", "-crowd_level", "crowd_level is not null", "crowd_level >= 4", "crowd_level >= 4 and conf >= 0.5", _BUSY_SQL)))
def q12(v):
    """Quiet places, the quietest first; for questions with a busy word and no quiet one the busiest."""
    level, busy = F.col("crowd_level"), _holds(R.BUSY_WORDS) & ~_holds(R.QUIET_WORDS)
    parts = [_profile_query(v, F.col("crowd_label"), level.isNotNull(), ok, ok & (F.col("conf") >= 0.5), order, asked) for ok, order, asked in ((level <= 2, level, ~busy), (level >= 4, -level, busy))]
    return parts[0].unionByName(parts[1])


def _cost_level_words():
    """Level to the words that ask for it, in the order in which a question's level is decided."""
    return [(level, [w for w, x in R.COST_WORDS.items() if x == level]) for level in ("FREE", "HIGH", "MODERATE", "LOW")]


def _cost_sql():
    """(level, SQL condition): the first level whose words a question holds; LOW if it holds none."""
    before, out = "false", []
    for level, words in _cost_level_words():
        sql = _any_word(words) if level != "LOW" else "true"
        out.append((level, f"({sql} and not ({before}))"))
        before = f"{before} or {sql}"
    return out


def _cost_columns():
    before, out = F.lit(False), []
    for level, words in _cost_level_words():
        col = _holds(words) if level != "LOW" else F.lit(True)
        out.append((level, col & ~before))
        before = before | col
    return out


@query("q13_cost", _two(*[_profile_sql("cost_level as value", "coalesce(median_lkr, 1000000000)", "cost_level is not null", f"cost_level = '{level}'", f"cost_level = '{level}' and conf >= 0.3", sql)
                          for level, sql in _cost_sql()]))
def q13(v):
    """Places of the cost level that the question's words ask for, the cheapest first."""
    out = None
    for level, asked in _cost_columns():
        ok = F.col("cost_level") == level
        part = _profile_query(v, F.col("cost_level"), F.col("cost_level").isNotNull(), ok, ok & (F.col("conf") >= 0.3), F.coalesce("median_lkr", F.lit(1000000000)), asked)
        out = part if out is None else out.unionByName(part)
    return out


_M15 = {"crowd": (R.CROWD_WORDS, "QUIET"), "time": (R.TIME_WORDS, None), "season": (R.SEASON_WORDS, None), "cost": (R.COST_WORDS, None)}
_WORDS = ["quiet", " Packed", "free", "dawn", "wet", "unheard", "expensive", "after dark"]


@query("m15_word_maps", f"with x as (select qid, lower(trim(({lit_list(_WORDS)})[1 + qid % {len(_WORDS)}])) as w from v_questions) select qid, " + ", ".join(
    f"{'coalesce(' if d else ''}case w " + " ".join(f"when {lit(k)} then {lit(x)}" for k, x in m.items()) + f" end{', ' + lit(d) + ')' if d else ''} as {n}" for n, (m, d) in _M15.items()) + " from x")
def m15(v):
    w = F.lower(F.trim(_pick(_WORDS, F.col("qid") % len(_WORDS))))
    return v.questions.select("qid", *[(F.coalesce(FX.lookup(m, w), F.lit(d)) if d else FX.lookup(m, w)).alias(n) for n, (m, d) in _M15.items()])


@query("t26_w8_day_labels", """
with recursive stp as materialized (select s.*, coalesce(l.t, 0) as t, place_name || ' (' || category || ')' as label from v_stops s join v_places p on p.place_id = s.place_id left join v_legs l on l.req_id = s.req_id and l.j = s.i and l.i = s.i - 1),
 f as (select req_id, i, 1 as day, dur as tm from stp where i = 0 union all select f.req_id, s.i, case when f.tm + s.dur + s.t > 480000000 and f.day < 3 then f.day + 1 else f.day end, case when f.tm + s.dur + s.t > 480000000 and f.day < 3 then s.dur + s.t else f.tm + s.dur + s.t end from f join stp s on s.req_id = f.req_id and s.i = f.i + 1),
 g as (select f.req_id, day, list(label order by f.i) as l from f join stp on stp.req_id = f.req_id and stp.i = f.i group by f.req_id, day)
select req_id, day, case len(l) when 1 then l[1] else array_to_string(list_concat(list_concat(['start-' || l[1]], l[2:-2]), ['end-' || l[-1]]), ' → ') end as summary, lag(l[-1]) over (partition by req_id order by day) || ' → ' || l[1] as connected_from from g""")
def t26(v):
    days = v.requests.select("req_id", F.explode(P.day_split(F.sequence(F.lit(0), F.col("n") - 1), F.lit(3), F.lit(8))).alias("x")).select("req_id", "x.day", "x.places")
    names = v.places.select("place_id", P.place_label(F.col("place_name"), F.col("category")).alias("label"))
    flat = days.select("req_id", "day", F.posexplode("places").alias("pos", "place_id")).join(names, "place_id")
    g = flat.groupBy("req_id", "day").agg(F.array_sort(F.collect_list(F.struct("pos", "label"))).alias("l")).withColumn("l", F.transform("l", lambda s: s["label"]))
    prev = F.lag(F.element_at("l", -1)).over(W.partitionBy("req_id").orderBy("day"))
    return g.select("req_id", "day", P.day_label(F.col("l")).alias("summary"), F.concat(prev, F.lit(" → "), F.get("l", F.lit(0))).alias("connected_from"))


# -- weather -------------------------------------------------------------------------------------------------
_MAIN = ["Clear", "Clouds", "Rain", "Mist", "Thunderstorm"]
VIEW_SQL["v_forecast"] = f"select event_id as slot_id, user_id as place_id, ts, cast(ts as date) as date, case when event_type = 'error' then 'Squall' else ({lit_list(_MAIN)})[1 + event_id % 5] end as main, case when event_id % 13 = 0 then 'Heavy Rain shower' else 'calm' end as description, value as temp from events"
VIEW_SQL["v_daily"] = """select *, bad_slots >= greatest(1, slots // 3) as is_bad from (select place_id, date, count(*) as slots, count(*) filter (lower(main) in ('rain', 'thunderstorm', 'drizzle', 'squall') or regexp_matches(lower(description), 'rain|storm|flood|drizzle|squall|shower')) as bad_slots,
 (list(main order by ts, slot_id))[count(*) // 2 + 1] as main, (list(temp order by ts, slot_id))[count(*) // 2 + 1] as temp from v_forecast group by place_id, date)"""
VIEW_SQL["v_grid"] = """select p.place_id, c.day, coalesce(is_bad, false) as is_bad, case when is_bad then '! ' || main else coalesce(main, 'No forecast') end as cell from (select distinct user_id as place_id from events) p, (select i as day, date '2024-01-10' + cast(i - 1 as int) as date from (select unnest(generate_series(1, 4)) as i)) c left join v_daily d on d.place_id = p.place_id and d.date = c.date"""


def slots(v):
    e = F.col("event_id")
    return v.table("events").select(e.alias("slot_id"), F.col("user_id").alias("place_id"), "ts", F.to_date("ts").alias("date"),
                                    F.when(F.col("event_type") == "error", "Squall").otherwise(_pick(_MAIN, e % 5)).alias("main"), F.when(e % 13 == 0, "Heavy Rain shower").otherwise("calm").alias("description"), F.col("value").alias("temp"))


def _grid(v):
    places = v.table("events").select(F.col("user_id").alias("place_id")).distinct()
    return WX.grid(places, WX.daily(slots(v)), "2024-01-10", 4)


@query("a36_f10_daily_forecast", "select place_id, cast(date as varchar) as date, slots, bad_slots, main, temp, is_bad from v_daily")
def a36(v):
    return WX.daily(slots(v)).select("place_id", F.col("date").cast("string").alias("date"), "slots", "bad_slots", "main", "temp", "is_bad")


@query("j24_weather_grid", "select place_id, " + ", ".join(f"max(cell) filter (day = {i}) as day_{i}" for i in range(1, 5)) + " from v_grid group by place_id")
def j24(v):
    return WX.wide_grid(_grid(v), 4)


@query("t27_route_explanation", """
with ok as (select s.req_id, count(*) as n, sum(s.dur) as visit, cast(sum(s.dur + coalesce(l.t, 0)) as bigint) as t, cast(sum(coalesce(l.d, 0)) as bigint) as d
  from v_stops s left join v_legs l on l.req_id = s.req_id and l.j = s.i and l.i = s.i - 1 group by s.req_id having bool_and(s.i = 0 or l.t is not null)),
 bad as (select s.req_id, string_agg(p.place_name, ', ' order by s.i) as names from v_stops s join v_daily w on w.place_id = s.place_id and w.date = date '2024-01-15' and w.is_bad join v_places p on p.place_id = s.place_id group by s.req_id)
select req_id, concat_ws('; ', 'ranked by attraction', n || ' stops, ' || t // 60000000 || ' h, ' || d // 1000000 || ' km', case when visit / t >= 0.6 then 'little time on the road' when visit / t < 0.4 then 'much time on the road' end,
 coalesce('bad weather at: ' || names, 'weather fine')) as explanation from ok left join bad using (req_id)""")
def t27(v):
    routes = P.route_metrics(v.requests.withColumn("ord", F.sequence(F.lit(0), F.col("n") - 1))).select("req_id", "total_time", "total_distance", "n_places")
    stops = v.requests.select("req_id", F.aggregate("dur", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("visit"), "stops")
    bad = WX.daily(slots(v)).filter("date = date '2024-01-15' and is_bad").select("place_id")
    named = stops.select("req_id", F.posexplode("stops").alias("pos", "place_id")).join(bad, "place_id").join(v.places.select("place_id", "place_name"), "place_id")
    names = named.groupBy("req_id").agg(F.array_sort(F.collect_list(F.struct("pos", "place_name"))).alias("s")).select("req_id", F.array_join(F.transform("s", lambda x: x["place_name"]), ", ").alias("bad"))
    r = routes.join(stops.drop("stops"), "req_id").join(names, "req_id", "left")
    c = {"places": F.col("n_places"), "hours": F.floor(F.col("total_time") / (60 * P.MICRO)), "km": F.floor(F.col("total_distance") / P.MICRO), "efficiency": F.col("visit") / F.col("total_time"), "bad": F.col("bad")}
    return r.select("req_id", P.explain_route("attraction", c).alias("explanation"))


@query("f11_weather_filter", "select place_id, count(*) filter (is_bad) as bad_days from v_grid group by place_id having place_id = 7 or not (count(*) filter (is_bad) = 4 or count(*) filter (is_bad) >= 3)")
def f11(v):
    return WX.kept_places(_grid(v), 4, F.lit(7))


@query("f12_current_weather_filter", "select place_id from v_places where place_id not in (select place_id from v_daily where date = date '2024-01-15' and is_bad)")
def f12(v):
    now = WX.daily(slots(v)).filter("date = date '2024-01-15'").select("place_id", "is_bad")
    return v.places.select("place_id").join(now, "place_id", "left").filter(~F.coalesce("is_bad", F.lit(False))).select("place_id")


@query("k10_weather_rerank", """with s as (select trip_id as req_id, place_id, least(pos, 4) as day from v_visits), p as (select req_id, count(*) as penalty from s join v_grid g on g.place_id = s.place_id and g.day = s.day and g.is_bad group by req_id)
select o_custkey, o_orderkey as req_id, coalesce(penalty, 0) as penalty, row_number() over (partition by o_custkey order by coalesce(penalty, 0), o_totalprice desc, o_orderkey) as rank from orders left join p on req_id = o_orderkey""")
def k10(v):
    s = v.visits.select(F.col("trip_id").alias("req_id"), "place_id", F.least("pos", F.lit(4)).alias("day"))
    r = WX.rerank(v.table("orders").select(F.col("o_orderkey").alias("req_id"), "o_custkey", "o_totalprice"), s, _grid(v))
    w = W.partitionBy("o_custkey").orderBy("penalty", F.desc("o_totalprice"), "req_id")
    return r.select("o_custkey", "req_id", "penalty", F.row_number().over(w).cast("bigint").alias("rank"))
