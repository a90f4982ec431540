"""Registered queries for place questions over the knowledge tables."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from placelore.functions import rules as R
from placelore.functions.geo import haversine_km
from placelore.operators import graphq as G
from placelore.operators import questions as Q
from placelore.plans.q_trips import _H, _HAV
from placelore.plans.registry import query
from placelore.plans.sqltext import lit_list
from placelore.session import meet
from placelore.sources.proxies import TERM_WORDS

_LOC = "(q.location = '' or contains(lower(h.district), lower(q.location)) or contains(lower(coalesce(h.province, '')), lower(q.location)))"
_FEAT = "(select place_id, string_agg(term, ', ' order by term) as top_feature from (select place_id, term, row_number() over (partition by place_id order by term) as rn from (select distinct place_id, term from v_has where kind = 'feature')) where rn <= 3 group by place_id)"


def _inside(h, q="q"):
    """A place is one of those that the question names, if any, and in one of its areas, if any."""
    m = f"from v_terms m where m.qid = {q}.qid and m.kind"
    return (f"(not exists (select 1 {m} = 'place') or exists (select 1 {m} = 'place' and lower(m.term) = lower({h}.place_name))) and "
            f"(not exists (select 1 {m} = 'location') or exists (select 1 {m} = 'location' and lower(m.term) in (lower({h}.district), lower(coalesce({h}.province, '')))))")


def _any_sql(kind, extra="", sentiment="h.sentiment <> 'negative'"):
    return f"""select distinct q.qid, q.suggested, h.* from v_asked q join v_terms t on t.qid = q.qid and t.kind = '{kind}'
   join v_has h on h.kind = '{kind}' and {sentiment} and contains(lower(h.term), lower(t.term)) where {_inside('h')} {extra}"""


def _ask_sql(kind, extra=""):
    return f"""with hit as ({_any_sql(kind, extra)}), r as (select *, row_number() over (partition by qid order by pct desc, place_name, term) as rank from hit)
select qid, place_name, term, sentiment, pct, district, category, coalesce(top_feature, '') as top_features, rank from r left join {_FEAT} using (place_id) where rank <= least(suggested, 10)"""


def _out(df):
    return df.select("qid", "place_name", "term", "sentiment", "pct", "district", "category", F.coalesce("top_feature", F.lit("")).alias("top_features"), F.col("rank").cast("bigint").alias("rank"))


@query("q1_activity_places", _ask_sql("activity"))
def q1(v):
    return _out(Q.ask_any(v.questions, v.terms, v.has, "activity"))


_AVOIDED = "and not exists (select 1 from v_avoided a where a.qid = q.qid and a.place_id = h.place_id)"


@query("q2_j8_feature_places", _ask_sql("feature", _AVOIDED))
def q2(v):
    return _out(Q.ask_any(v.questions, v.terms, v.has, "feature", avoided=v.avoided))


@query("q3_facility_places", _ask_sql("facility"))
def q3(v):
    return _out(Q.ask_any(v.questions, v.terms, v.has, "facility"))


@query("m14_question_terms", "select qid, kind, term from v_matched")
def m14(v):
    return v.matched.select("qid", "kind", "term")


_TERMS = "(select place_id, place_name, district, category, " + ", ".join(f"coalesce(string_agg(term, ', ' order by pct desc, term) filter (kind = '{k}'), '') as {k}" for k in ("activity", "feature", "facility")) + " from v_has group by all)"


@query("q4_place_terms", f"select q.qid, t.place_id, t.place_name, district, category, t.activity as activities, t.feature as features, t.facility as facilities from v_questions q join {_TERMS} t on lower(t.place_name) = lower(q.place)")
def q4(v):
    t = G.place_terms(v.has).withColumn("_k", F.lower("place_name"))
    q = v.questions.select("qid", F.lower("place").alias("_k"))
    return q.join(t, "_k").select("qid", "place_id", "place_name", "district", "category", F.col("activity").alias("activities"), F.col("feature").alias("features"), F.col("facility").alias("facilities"))


@query("q5_location_places", """
with loc as (select distinct location from v_questions where location <> ''), d as (select location, p.* from loc join v_places p on contains(lower(district), lower(location))),
 pr as (select location, p.* from loc join v_places p on contains(lower(province), lower(location)) where location not in (select location from d)), u as (select * from d union all select * from pr)
select qid, place_id, place_name, district, province from v_questions q join u using (location)""")
def q5(v):
    return meet(v.questions.filter("location <> ''").select("qid", "location"), G.location_places(v.questions, v.places), ["location"]).drop("location")


@query("q6_comparison", f"""
with t as (select *, {_TERMS.replace('(select place_id', '0 from (select place_id', 1)[:0]} 1 as one from {_TERMS}), q as (select qid, unnest([place, 'Supplier#' || lpad(cast(qid % 90 as varchar), 9, '0')]) as name from v_questions where intent = 'comparison_query')
select distinct qid, place_name, t.activity as activities, t.facility as facilities from q join t on contains(lower(place_name), lower(name))""")
def q6(v):
    q = v.questions.filter("intent = 'comparison_query'").select("qid", F.explode(F.array("place", F.concat(F.lit("Supplier#"), F.lpad((F.col("qid") % 90).cast("string"), 9, "0")))).alias("name"))
    hit = G.contains_join(q, "name", v.places.select("place_id", "place_name"), "place_name").select("name", "place_id")
    t = G.place_terms(v.has).select("place_id", "place_name", F.col("activity").alias("activities"), F.col("facility").alias("facilities"))
    return q.join(hit, "name").join(t, "place_id").select("qid", "place_name", "activities", "facilities").distinct()


@query("q7_constraints", f"""
with f as (select *, row_number() over (partition by qid order by pct desc, place_name, term) as rn from ({_any_sql('feature', _AVOIDED, "h.sentiment = 'positive'")})),
 a as (select *, row_number() over (partition by qid order by pct desc, place_name, term) as rn from ({_any_sql('activity', _AVOIDED)}))
select qid, place_name, term, pct from f where rn <= 12 union all select qid, place_name, term, pct from a where rn <= 8""")
def q7(v):
    q = v.questions.withColumn("suggested", F.lit(100))
    f = Q.ask_any(q, v.terms, v.has, "feature", avoided=v.avoided, sentiment=F.col("sentiment") == "positive", limit=12, features=None)
    a = Q.ask_any(q, v.terms, v.has, "activity", avoided=v.avoided, limit=8, features=None)
    cols = ["qid", "place_name", "term", "pct"]
    return f.select(*cols).unionByName(a.select(*cols))


@query("q8_explanation", f"""
with n as (select place_id, review_id, text, row_number() over (partition by place_id order by rating desc, review_id, text) as rn from (select distinct place_id, review_id, rating, text from v_notes))
select q.qid, t.place_name, t.activity as activities, n.rn, n.text from v_questions q join {_TERMS} t on lower(t.place_name) = lower(q.place) join n on n.place_id = t.place_id and rn <= 3""")
def q8(v):
    w = W.partitionBy("place_id").orderBy(F.desc("rating"), "review_id", "text")
    d = W.partitionBy("place_id", "review_id", "rating", "text").orderBy("l_partkey")
    notes = v.notes.withColumn("_d", F.row_number().over(d)).filter("_d = 1").withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("place_id", F.col("rn").cast("bigint").alias("rn"), "text")
    t = G.place_terms(v.has).select("place_id", "place_name", F.col("activity").alias("activities"), F.lower("place_name").alias("_k"))
    return v.questions.select("qid", F.lower("place").alias("_k")).join(t, "_k").join(notes, "place_id").select("qid", "place_name", "activities", "rn", "text")


@query("q9_multi_criteria", f"""
with w as (select qid, kind, term from v_terms where kind in ('activity', 'facility')), n as (select qid, count(distinct kind) as k from w group by qid having count(distinct kind) > 1),
 hit as (select w.qid, h.place_id, h.place_name, h.district, h.province, count(distinct w.kind) as k from w join v_has h on h.kind = w.kind and contains(lower(h.term), lower(w.term))
   and ((h.kind = 'activity' and h.pct >= 15) or (h.kind = 'facility' and h.sentiment <> 'negative')) group by all)
select h.qid, h.place_id, h.place_name, t.feature as features from hit h join n using (qid, k) join {_TERMS} t on t.place_id = h.place_id
where (not exists (select 1 from v_terms m where m.qid = h.qid and m.kind = 'location') or exists (select 1 from v_terms m where m.qid = h.qid and m.kind = 'location' and lower(m.term) in (lower(h.district), lower(coalesce(h.province, '')))))""")
def q9(v):
    features = G.place_terms(v.has).select("place_id", F.col("feature").alias("features"))
    kinds = {"activity": F.col("pct") >= 15, "facility": F.col("sentiment") != "negative"}
    return Q.meet_all(v.terms.join(v.questions.select("qid"), "qid", "left_semi"), v.has, kinds, facts=features)


_NEAR = _H.format(h=_HAV.format(a="a.", b="b."))


@query("q10_j17_nearest_places", f"""
select place_id, near_id, km, rank from (select a.place_id, b.place_id as near_id, round({_NEAR}, 6) as km, row_number() over (partition by a.place_id order by round({_NEAR}, 6), b.place_id) as rank
 from v_places a join v_places b on a.place_id <> b.place_id) where rank <= 5""")
def q10(v):
    n = G.nearest(v.places, v.places, 5)
    return n.select("place_id", "near_id", F.round("km", 6).alias("km"), F.col("rank").cast("bigint").alias("rank"))


@query("q10_nearby_with_attribute", f"""
with s as (select * from v_places where place_id in (select place_id from v_has where kind = 'activity' and term = '{TERM_WORDS[2]}' and pct >= 15 and sentiment <> 'negative'))
select place_id, near_id, km from (select a.place_id, b.place_id as near_id, round(coalesce(r.distance_km, 1.2 * {_NEAR}), 4) as km, row_number() over (partition by a.place_id order by round({_NEAR}, 6), b.place_id) as rank
 from v_places a join s b on a.place_id <> b.place_id left join v_edges r on r.a = a.place_id and r.b = b.place_id) where rank <= 3""")
def q10b(v):
    ok = v.has.filter(f"kind = 'activity' and term = '{TERM_WORDS[2]}' and pct >= 15 and sentiment <> 'negative'").select("place_id")
    n = G.nearest(v.places, v.places.join(ok, "place_id", "left_semi"), 3)
    r = v.edges.select(F.col("a").alias("place_id"), F.col("b").alias("near_id"), "distance_km")
    return n.join(r, ["place_id", "near_id"], "left").select("place_id", "near_id", F.round(F.coalesce("distance_km", 1.2 * F.col("km")), 4).alias("km"))


@query("k2_closest_by_road", "select a as place_id, b as near_id, distance_km from (select *, row_number() over (partition by a order by distance_km, b) as rn from v_roads where distance_km > 0) where rn <= 5")
def k2(v):
    w = W.partitionBy("a").orderBy("distance_km", "b")
    return v.roads.filter("distance_km > 0").withColumn("rn", F.row_number().over(w)).filter("rn <= 5").select(F.col("a").alias("place_id"), F.col("b").alias("near_id"), "distance_km")


@query("j13_same_district", "select q.qid, b.place_name from v_questions q join v_places a on lower(a.place_name) = lower(q.place) join v_places b on a.district = b.district and a.place_id <> b.place_id")
def j13(v):
    p = v.places
    anchor = v.questions.select("qid", F.lower("place").alias("_k")).join(p.select(F.lower("place_name").alias("_k"), "district", F.col("place_id").alias("anchor")), "_k")
    return anchor.join(p.select("district", "place_id", "place_name"), "district").filter("place_id <> anchor").select("qid", "place_name")


@query("j20_pairwise_distances", "select req_id, i, j, d / 1e6 as km, row_number() over (partition by req_id order by d, i, j) as rank from v_legs where i < j")
def j20(v):
    r = v.requests.select("req_id", "n", F.posexplode("dm").alias("k", "d")).filter("d is not null")
    r = r.select("req_id", F.floor(F.col("k") / F.col("n")).alias("i"), (F.col("k") % F.col("n")).cast("bigint").alias("j"), "d").filter("i < j")
    w = W.partitionBy("req_id").orderBy("d", "i", "j")
    return r.select("req_id", "i", "j", (F.col("d") / 1000000).alias("km"), F.row_number().over(w).cast("bigint").alias("rank"))


@query("j5_ground_terms", """
with t as (select distinct activity as term from v_questions union select location from v_questions where location <> '' union select substr(place, 12) from v_questions), n as (select distinct term as name from v_pop union select district from v_places union select province from v_places union select place_name from v_places),
 h as (select t.term, name, row_number() over (partition by t.term order by case when lower(name) = lower(t.term) then 0 else 1 end, length(name), name) as rn from t join n on contains(lower(name), lower(t.term)))
select t.term, coalesce(name, t.term) as grounded, name is not null as found from t left join h on h.term = t.term and rn = 1""")
def j5(v):
    q, p = v.questions, v.places
    one = lambda df, c: df.select(F.expr(c).alias("x"))
    t = one(q, "activity").union(one(q.filter("location <> ''"), "location")).union(one(q, "substring(place, 12)")).toDF("term").distinct()
    names = one(v.pop, "term").union(one(p, "district")).union(one(p, "province")).union(one(p, "place_name")).toDF("name").distinct()
    return G.ground(t, names)


@query("j18_prefix_names", """with t as (select distinct substr(lower(place), 1, 12 + qid % 7) as term from v_questions)
select term, name as resolved from (select term, place_name as name, row_number() over (partition by term order by case when lower(place_name) = term then 0 else 1 end, place_name) as rn from t join v_places on starts_with(lower(place_name), term)) where rn = 1""")
def j18(v):
    t = v.questions.select(F.substring(F.lower("place"), F.lit(1), (12 + F.col("qid") % 7).cast("int")).alias("term"))
    return G.resolve_prefix(t, v.places.select(F.col("place_name").alias("name")))


@query("j19_fuzzy_names", """with n as (select distinct p_name as name from part), t as (select distinct substr(p_name, 1, 2) || substr(p_name, 4) || 'x' as term from part)
select term, name, round(s, 6) as similarity from (select term, name, 1 - levenshtein(term, name) / greatest(length(term), length(name)) as s, row_number() over (partition by term order by 1 - levenshtein(term, name) / greatest(length(term), length(name)) desc, name) as rn from t, n) where rn = 1 and s >= 0.65""")
def j19(v):
    p = v.table("part")
    t = p.select(F.concat(F.substring("p_name", 1, 2), F.substring("p_name", 4, 100), F.lit("x")).alias("term"))
    return G.fuzzy_match(t, p.select(F.col("p_name").alias("name"))).select("term", "name", F.round("similarity", 6).alias("similarity"))


@query("j9_drop_mentions", """with n as (select distinct lower(split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)) as name from benchmark)
select doc_id from documents d where not exists (select 1 from n where contains(lower(d.text), n.name))""")
def j9(v):
    n = v.table("benchmark").select(F.lower(F.concat_ws(" ", F.split_part("text", F.lit(" "), F.lit(1)), F.split_part("text", F.lit(" "), F.lit(2)))).alias("name")).distinct()
    return G.drop_mentions(v.documents.select("doc_id", "text"), n).select("doc_id")


@query("j22_attach_chunks", """with d as (select doc_id, case when doc_id % 6 = 0 then '' else source end as doc_place, text from documents), n as (select distinct source as name from documents where source < 'src15' union select 'schung'),
 h as (select doc_id, name, text from d join n on (doc_place <> '' and (contains(doc_place, name) or contains(name, doc_place))) or (doc_place = '' and contains(lower(text), name))),
 o as (select *, row_number() over (partition by doc_id order by name) as r1 from h)
select doc_id, name from (select *, row_number() over (partition by name, md5(text) order by doc_id) as r2 from o where r1 = 1) where r2 = 1""")
def j22(v):
    d = v.documents.select("doc_id", F.when(F.col("doc_id") % 6 == 0, "").otherwise(F.col("source")).alias("doc_place"), "text")
    n = v.documents.filter("source < 'src15'").select(F.col("source").alias("name")).distinct().union(v.spark.createDataFrame([("schung",)], "name string"))
    return G.attach_chunks(d, n).select("doc_id", "name")


@query("q14_route_choice", f"""select qid, case when intent = 'nearby_query' or len(list_intersect(string_split(lower(question), ' '), {lit_list(R.NEAR_WORDS)})) > 0 then 'nearby' when intent = 'comparison_query' then 'comparison'
 when activity <> '' and conv % 3 = 0 then 'multi_hop' when intent = 'general_query' then 'general' else replace(intent, '_query', '') end as route from (select *, qid // 100 as conv from v_questions)""")
def q14(v):
    multi = F.floor(F.col("qid") / 100) % 3 == 0
    q = v.questions.withColumn("feature", F.when(multi, F.col("feature")).otherwise("")).withColumn("facility", F.lit("")).withColumn("location", F.lit(""))
    return q.select("qid", G.route_of({c: F.col(c) for c in ("question", "intent", "activity", "feature", "facility", "location")}).alias("route"))


@query("q15_j21_enrich_itinerary", f"select s.req_id, s.pos, t.place_name, t.category, t.activity as activities from v_req_stops s join {_TERMS} t on s.place_id = t.place_id")
def q15(v):
    t = G.place_terms(v.has).select("place_id", "place_name", "category", F.col("activity").alias("activities"))
    return v.req_stops.join(t, "place_id").select("req_id", F.col("pos").cast("bigint").alias("pos"), "place_name", "category", "activities")


@query("q16_strong_facts", "select place_name, kind, term, pct from v_has where pct > 18 order by pct desc, place_name, kind, term limit 50")
def q16(v):
    return v.has.filter("pct > 18").select("place_name", "kind", "term", "pct").orderBy(F.desc("pct"), "place_name", "kind", "term").limit(50)


VIEW_FACTS = f"(select qid, question, kind, place_name, term, sentiment, pct, district, rank from (select q.qid, q.question, q.suggested, h.*, row_number() over (partition by q.qid order by pct desc, place_name, term) as rank from v_questions q join v_has h on h.kind = 'activity' and h.sentiment <> 'negative' and contains(lower(h.term), lower(q.activity)) and {_LOC}) where rank <= least(suggested, 10))"
_LINE = """'Knowledge Graph Fact ' || rank || '.   Place: ' || place_name || '   Activity: ' || term || '   Sentiment: ' || sentiment || case when regexp_matches(lower(question), 'percent|score|statistic|rating') then '   Percentage: ' || cast(pct as varchar) || '%' else '' end || '   District: ' || district"""


def _facts(v):
    return G.ask_terms(v.questions, v.has, v.places, "activity", "activity", features=None).join(v.questions.select("qid", "question"), "qid")


@query("t30_w10_fact_text", f"select qid, string_agg({_LINE}, chr(10) || chr(10) order by rank) as graph_text from {VIEW_FACTS} group by qid")
def t30(v):
    return G.render_facts(_facts(v))


_DOCS = "(select qid, text from (select qid, text, row_number() over (partition by qid order by r) as rn from (select q.qid, c.text, c.turn as r from v_questions q join conversations c on c.conv_id = q.qid // 100 and c.role = 'assistant')) where rn <= 5)"


def _docs(v, most=5):
    """The first answers of each question, as many as the text score divides by."""
    c = v.table("conversations").filter("role = 'assistant'").select("conv_id", "turn", "text")
    d = v.questions.select("qid", F.floor(F.col("qid") / 100).alias("conv_id")).join(c, "conv_id")
    return d.withColumn("rn", F.row_number().over(W.partitionBy("qid").orderBy("turn"))).filter(F.col("rn") <= most)


_QUAL = f"""select qid, least(1, n_facts / 10 * avg_pct / 100) as g, least(1, n_docs / 5) as t from (select q.qid, coalesce(n_facts, 0) as n_facts, coalesce(avg_pct, 0) as avg_pct, coalesce(n_docs, 0) as n_docs from v_questions q
  left join (select qid, count(*) as n_facts, avg(pct) as avg_pct from {VIEW_FACTS} group by qid) using (qid) left join (select qid, count(*) as n_docs from {_DOCS} group by qid) using (qid))"""


@query("a37_retrieval_quality", f"select qid, round(g, 6) as graph_score, round(t, 6) as text_score, round(case when g + t > 0 then g / (g + t) else 0.5e0 end, 6) as graph_weight, round(case when g + t > 0 then t / (g + t) else 0.5e0 end, 6) as text_weight from ({_QUAL})")
def a37(v):
    x = G.retrieval_quality(_facts(v), _docs(v), v.questions)
    return x.select("qid", *[F.round(c, 6).alias(c) for c in ("graph_score", "text_score", "graph_weight", "text_weight")])


def _context(v):
    docs = _docs(v).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rn", F.concat(F.col("rn").cast("string"), F.lit(". "), F.trim("text")).alias("t")))).alias("l")).select(
        "qid", F.array_join(F.transform("l", lambda x: x["t"]), "\n\n").alias("doc_text"))
    x = G.retrieval_quality(_facts(v), _docs(v), v.questions)
    return G.merge_context(x.join(G.render_facts(_facts(v)), "qid", "left").join(docs, "qid", "left"))


@query("t31_context_blocks", f"""
with w as ({_QUAL}), f as (select qid, string_agg({_LINE}, chr(10) || chr(10) order by rank) as g from {VIEW_FACTS} group by qid), d as (select qid, string_agg(rn || '. ' || trim(text), chr(10) || chr(10) order by rn) as d from (select qid, text, row_number() over (partition by qid order by r) as rn from (select q.qid, c.text, c.turn as r from v_questions q join conversations c on c.conv_id = q.qid // 100 and c.role = 'assistant')) where rn <= 5 group by qid),
 x as (select w.qid, 'GRAPH FACTS:' || chr(10) || coalesce(f.g, 'No graph results returned.') as gt, 'REVIEW EVIDENCE:' || chr(10) || coalesce(d.d, 'No review evidence returned.') as dt, f.g is null and w.t > w.g as text_first from w left join f using (qid) left join d using (qid))
select qid, text_first, md5(case when text_first then dt || chr(10) || chr(10) || gt else gt || chr(10) || chr(10) || dt end) as context_md5 from x""")
def t31(v):
    return _context(v).select("qid", "text_first", F.md5("context").alias("context_md5"))


@query("t32_context_chunks", f"""with n as (select qid, count(*) as f from {VIEW_FACTS} group by qid), d as (select qid, count(*) as d from {_DOCS} group by qid)
select qid, coalesce(f, 0) as facts from v_questions left join n using (qid)""")
def t32(v):
    c = G.context_chunks(_context(v))
    return c.groupBy("qid").agg(F.count_if(F.col("kind") == "fact").alias("facts"))


@query("s12_a41_graph_tables", """
with p as (select place_name, coalesce(nullif(district, ''), 'Unknown') as district, coalesce(province, 'Unknown') as province, coalesce(nullif(category, 'Roundabout'), 'Uncategorized') as category from v_places)
select 'node' as item, label, count(distinct name) as n from (select 'Place' as label, place_name as name from p union all select 'District', district from p union all select 'Province', province from p union all select 'Category', category from p
  union all select case kind when 'activity' then 'Activity' when 'feature' then 'Feature' else 'Facility' end, term from v_has) group by label
union all select 'edge', 'HAS_' || upper(kind), count(*) from v_has group by kind union all select 'edge', 'LOCATED_IN', count(*) from p union all select 'edge', 'HAS_CATEGORY', count(*) from p union all select 'edge', 'PART_OF', count(distinct district || province) from p""")
def s12(v):
    places = v.places.withColumn("category", F.when(F.col("category") != "Roundabout", F.col("category")).otherwise(" "))
    twice = v.has.withColumn("version", F.lit(1)).unionByName(v.has.withColumn("version", F.lit(2)))
    nodes, links = G.graph_nodes_edges(places, twice)
    n = nodes.groupBy("label").agg(F.count("*").alias("n")).select(F.lit("node").alias("item"), "label", "n")
    return n.unionByName(links.groupBy(F.col("relation").alias("label")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("item"), "label", "n"))
