"""Registered queries over the review pipeline: de-duplication, resume, merging, sampling, sheets."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from placelore.functions import text as X
from placelore.operators import dedup as D
from placelore.operators import sampling as S
from placelore.operators import reviews as RV
from placelore.plans.q_text import STOP, _LANG, _SENT, _clean_sql
from placelore.plans.registry import query
from placelore.plans.sqltext import lit_list

_KEY = "regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '^ | $', '', 'g')"


@query("x1_url_dedup", """
select review_id, place_key from (select *, row_number() over (partition by place_key, url order by review_id) as rn from v_reviews) where rn = 1 or url = ''""")
def x1(v):
    return D.by_url(v.reviews).select("review_id", "place_key")


@query("x2_exact_text_dedup", f"""
select review_id, place_key from (select *, {_KEY} as k, row_number() over (partition by place_key, {_KEY} order by review_id) as rn from v_reviews) where rn = 1 or k = ''""")
def x2(v):
    return D.by_text(v.reviews).select("review_id", "place_key")


def _pairs_sql(source: str, threshold: float) -> str:
    """CTEs p_* over a source with (review_id, place_key, text_clean)."""
    return f"""
 p_t as (select place_key, min(review_id) as rep, count(*) as copies, any_value(text_clean) as text from {source} group by place_key, md5(text_clean)),
 p_tf as (select place_key, rep, copies, term, count(*) as tf from (
     select place_key, rep, copies, unnest(regexp_extract_all(lower(text), '[\\pL\\pN_]{{2,}}')) as term from p_t) where not list_contains({lit_list(STOP)}, term) group by all),
 p_v as (select place_key, term, sum(copies) as df from p_tf group by place_key, term),
 p_n as (select place_key, sum(copies) as n from p_t group by place_key),
 p_x as (select p_tf.place_key, rep, p_tf.term, tf * (ln((1 + n) / (1 + df)) + 1) as x from p_tf join p_v on p_tf.place_key = p_v.place_key and p_tf.term = p_v.term join p_n on p_n.place_key = p_tf.place_key),
 p_w as (select *, x / sqrt(sum(x * x) over (partition by rep)) as w from p_x),
 p_pairs as (select s.place_key, s.rep as a, t.rep as b, sum(s.w * t.w) as similarity from p_w s join p_w t
     on s.place_key = t.place_key and s.term = t.term and s.rep < t.rep group by all having sum(s.w * t.w) >= {threshold})"""


_IN = "x_in as (select review_id, place_key, text, user_name, lower(text) as text_clean from v_reviews)"


@query("x3_near_duplicate_pairs", f"with {_IN}, {_pairs_sql('x_in', 0.8)} select place_key, a, b, round(similarity, 6) as similarity from p_pairs")
def x3(v):
    texts = D.distinct_texts(v.reviews.withColumn("text_clean", F.lower("text")))
    pairs = D.near_duplicate_pairs(D.tf_idf_vectors(texts, STOP), 0.8)
    return pairs.select("place_key", "a", "b", F.round("similarity", 6).alias("similarity"))


def _kept_sql(source: str) -> str:
    return f"""
 k_e as (select a, b from p_pairs union all select b, a from p_pairs),
 k_r as (select a as node, a as other from k_e union select k_r.node, k_e.b from k_r join k_e on k_r.other = k_e.a),
 k_c as (select node, min(other) as label from k_r group by node),
 k_g as (select s.*, coalesce(label, rep) as grp from {source} s join p_t on s.place_key = p_t.place_key and md5(s.text_clean) = md5(p_t.text) left join k_c on node = rep),
 k_keep as (select * exclude (rn) from (select *, row_number() over (partition by place_key, grp order by length(text) + case when user_name is not null then 1000 else 0 end desc, review_id) as rn from k_g) where rn = 1)"""


@query("x4_drop_near_duplicates", f"with recursive {_IN}, {_pairs_sql('x_in', 0.8)}, {_kept_sql('x_in')} select review_id, place_key from k_keep")
def x4(v):
    kept = D.drop_near_duplicates(v.reviews.withColumn("text_clean", F.lower("text")), STOP, 0.8)
    return kept.select("review_id", "place_key")


@query("a1_x5_preprocess_report", f"""
with recursive lang as ({_LANG}),
 eng as (select r.*, lower({_clean_sql("r.text")}) as text_clean from v_reviews r join lang l on r.review_id = l.doc_id where detected = 'en' and conf >= 0.7),
 filled as (select * from eng where trim(text_clean) <> ''),
 xa as (select * exclude (rn) from (select *, row_number() over (partition by place_key, {_KEY} order by review_id) as rn from filled where src = 'A') where rn = 1),
 xb as (select * exclude (rn) from (select *, row_number() over (partition by place_key, url order by review_id) as rn from filled where src = 'B') where rn = 1 or url = ''),
 {_pairs_sql('xb', 0.95)}, {_kept_sql('xb')},
 xab as (select review_id, place_key, text, src from xa union all select review_id, place_key, text, src from k_keep),
 fin as (select * from (select *, row_number() over (partition by place_key, {_KEY} order by src, review_id) as rn from xab) where rn = 1),
 c as (select place_key, 'original' as item from v_reviews union all select place_key, 'english' from eng union all select place_key, 'filled' from filled
   union all select place_key, 'a_in' from filled where src = 'A' union all select place_key, 'b_in' from filled where src = 'B'
   union all select place_key, 'a' from xa union all select place_key, 'b_url' from xb union all select place_key, 'b' from k_keep
   union all select place_key, 'both' from xab union all select place_key, 'final' from fin),
 g as (select place_key, item, count(*) as n from c group by place_key, item union all select '(all)', item, count(*) from c group by item),
 w as (select place_key, {", ".join(f"cast(coalesce(sum(n) filter (item = '{i}'), 0) as bigint) as n_{i}" for i in ["original", "english", "filled", "a_in", "b_in", "a", "b_url", "b", "both", "final"])} from g group by place_key)
select place_key, n_original as original, n_original - n_english as non_english, n_english - n_filled as empty, n_b_in - n_b_url as url_removed,
  n_b_url - n_b as fuzzy_removed, n_a_in - n_a + n_both - n_final as exact_removed, n_final as final from w""")
def a1(v):
    r = v.reviews
    return D.preprocess_report(r, D.preprocess(r, STOP))


@query("a1_language_histogram", f"""
select coalesce(source, '(all)') as place_key, detected as language, count(*) as n from ({_LANG}) group by grouping sets ((source, detected), (detected))""")
def a1_lang(v):
    from placelore.operators import language as L

    d = L.detect(v.documents)
    g = d.groupBy("source", "lang_detected").agg(F.count("*").alias("n"))
    total = g.groupBy("lang_detected").agg(F.sum("n").alias("n")).select(F.lit("(all)").alias("place_key"), F.col("lang_detected").alias("language"), "n")
    return g.select(F.col("source").alias("place_key"), F.col("lang_detected").alias("language"), "n").unionByName(total)


@query("x6_distinct_routes", """
select route, min(trip_id) as first_trip, count(*) as n from (select trip_id, string_agg(cast(place_id as varchar), '>' order by pos) as route from v_visits group by trip_id) group by route""")
def x6(v):
    from placelore.operators.trips import route_arrays

    r = route_arrays(v.visits, "trip_id").select("trip_id", F.transform("route", lambda x: x.cast("string")).alias("route"))
    return r.groupBy("route").agg(F.min("trip_id").alias("first_trip"), F.count("*").alias("n")).withColumn("route", F.array_join("route", ">"))


@query("x8_set_operations", """
select place_id, 'all_months' as item from (select l_suppkey as place_id, count(distinct month(l_shipdate)) as m from lineitem group by 1) where m = 12
union all (select l_suppkey, 'sold_not_returned' from lineitem where l_linestatus = 'O' except select l_suppkey, 'sold_not_returned' from lineitem where l_returnflag = 'R' and l_quantity = 50)
union all (select l_suppkey, 'both' from lineitem where l_quantity = 1 intersect select l_suppkey, 'both' from lineitem where l_quantity = 50)
union all select s_suppkey, 'any' from supplier where s_suppkey in (select l_suppkey from lineitem where l_quantity = 50 union select l_suppkey from lineitem where l_quantity = 1)""")
def x8(v):
    li = v.table("lineitem").withColumnRenamed("l_suppkey", "place_id")
    months = li.groupBy("place_id").agg(F.countDistinct(F.month("l_shipdate")).alias("m")).filter("m = 12").select("place_id")
    at = lambda cond: li.filter(cond).select("place_id")
    tag = lambda df, name: df.select("place_id", F.lit(name).alias("item"))
    return (tag(months, "all_months")
            .unionByName(tag(at("l_linestatus = 'O'").subtract(at("l_returnflag = 'R' and l_quantity = 50")), "sold_not_returned"))
            .unionByName(tag(at("l_quantity = 1").intersect(at("l_quantity = 50")), "both"))
            .unionByName(tag(at("l_quantity = 50").union(at("l_quantity = 1")).distinct(), "any")))


@query("x9_vocabulary_conflicts", """
with k as (select 'type' as vocab, lower(p_type) as word from part union select 'name', lower(split_part(p_name, ' ', 1)) from part union select 'brand', lower(p_brand) from part
           union select 'name2', lower(split_part(p_name, ' ', 1)) from part where p_size > 25)
select word, count(distinct vocab) as n, string_agg(distinct vocab, '|' order by vocab) as vocabs from k group by word having count(distinct vocab) > 1""")
def x9(v):
    p = v.table("part")
    first = F.lower(F.split_part("p_name", F.lit(" "), F.lit(1)))
    k = RV.vocabularies({"type": p.select(F.lower("p_type")), "name": p.select(first), "brand": p.select(F.lower("p_brand")),
                         "name2": p.filter("p_size > 25").select(first)})
    return RV.conflicts(k)


@query("x7_ordered_distinct", """
select conv_id, string_agg(role, '|' order by t) as roles from (select conv_id, role, min(turn) as t from conversations group by conv_id, role) group by conv_id""")
def x7(v):
    c = v.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return c.select("conv_id", F.array_join(F.array_distinct(F.transform("t", lambda x: x["role"])), "|").alias("roles"))


@query("x10_append_new_content", f"""
with base as (select doc_id as id, text from documents where source = 'src0'), extra as (select doc_id as id, text from documents where source <> 'src0')
select id, 'base' as origin from base union all
select min(id), 'extra' from extra where md5({_KEY}) not in (select md5({_KEY}) from base) group by md5({_KEY})""")
def x10(v):
    d = v.documents.select(F.col("doc_id").alias("id"), "text", "source")
    return RV.append_new(d.filter("source = 'src0'"), d.filter("source <> 'src0'")).select("id", "origin")


@query("f14_f19_label_rows", """
select doc_id, case when quality = 1 and toxic = 0 then 1 else 0 end as positive, (n_chars % 3 <> 0) as labelled, (quality = 1 and n_chars % 3 = 0) as needs_label
from documents join labels using (doc_id)""")
def f14(v):
    d = v.documents.select("doc_id", "n_chars").join(v.table("labels"), "doc_id")
    d = d.withColumn("value", F.when(F.col("n_chars") % 3 != 0, F.lit("x")).otherwise(" "))
    return d.select("doc_id", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0).alias("positive"),
                    RV.filled("value").alias("labelled"), RV.needs_label(F.col("quality") == 1, "value").alias("needs_label"))


@query("k7_stratified_sample", """
with s as (select doc_id, source, quality, md5('42|' || doc_id) as d from documents join labels using (doc_id)),
     r as (select *, row_number() over (partition by quality order by d, doc_id) as rn from s)
select doc_id, quality from r where rn <= 50""")
def k7(v):
    s = v.documents.select("doc_id", "source").join(v.table("labels"), "doc_id")
    return S.stratified(s, ["quality"], 50, 42, ["doc_id"]).select("doc_id", "quality")


@query("k8_f15_borderline_sample", """
with sc as (select event_id, event_type as category, user_id, value / 100 as score from events),
 th as (select 'click' as category, 0.34 as t union all select 'view', 0.34 union all select 'purchase', 0.30),
 b as (select *, case when score >= t and score <= t + 0.05e0 then 'above' when score < t and score >= t - 0.05e0 then 'below' end as band from sc join th using (category)),
 o as (select *, row_number() over (partition by event_id order by category) as r1 from b where band is not null),
 d as (select *, row_number() over (partition by category, band order by md5('7|' || event_id), event_id) as rn from o where r1 = 1)
select event_id, category, band from d where rn <= 10""")
def k8(v):
    sc = v.table("events").select("event_id", F.col("event_type").alias("category"), (F.col("value") / 100).alias("score"))
    th = v.spark.createDataFrame([("click", 0.34), ("view", 0.34), ("purchase", 0.30)], "category string, threshold double")
    return S.borderline_sample(S.borderline(sc, th), 20, 7, "event_id").select("event_id", "category", "band")


@query("j10_leakage_guard", f"""
with pool as (select doc_id, regexp_replace(regexp_replace(lower(x), '\\s+', ' ', 'g'), '^ | $', '', 'g') as k from (select doc_id, unnest({_SENT.format(t="text")}) as x from documents)),
     gold as (select regexp_replace(regexp_replace(lower(x), '\\s+', ' ', 'g'), '^ | $', '', 'g') as k from (select unnest({_SENT.format(t="text")}) as x from benchmark))
select doc_id, count(*) as n, count(*) filter (not exists (select 1 from gold where gold.k = pool.k)) as kept from pool group by doc_id""")
def j10(v):
    keyed = lambda t, *c: v.table(t).select(*c, F.explode(X.sentences(F.col("text"))).alias("x")).select(*c, X.sentence_key(F.col("x")).alias("k"))
    pool = keyed("documents", "doc_id")
    kept = RV.without_gold(pool, keyed("benchmark"), "k").groupBy("doc_id").agg(F.count("*").alias("kept"))
    return pool.groupBy("doc_id").agg(F.count("*").alias("n")).join(kept, "doc_id", "left").na.fill(0)


@query("j11_skip_labelled", """
select doc_id, 'old' as origin from labels union all select doc_id, 'new' from documents where not exists (select 1 from labels where labels.doc_id = documents.doc_id)""")
def j11(v):
    old = v.table("labels").select("doc_id")
    new = v.documents.select("doc_id").join(old, "doc_id", "left_anti")
    return old.withColumn("origin", F.lit("old")).unionByName(new.withColumn("origin", F.lit("new")))


@query("j23_restore_labels", """
select d.doc_id, coalesce(cast(quality as varchar), '') as true_quality, case when n_chars > 1000 then 1 else 0 end as system_quality
from documents d left join labels l on d.doc_id = l.doc_id""")
def j23(v):
    sheet = v.documents.select("doc_id", F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("system_quality"), F.lit("").alias("true_quality"))
    old = v.table("labels").select("doc_id", F.col("quality").cast("string").alias("true_quality"))
    return RV.restore(sheet, old, "doc_id", ["true_quality"])


@query("j26_questions_with_results", """
select c.conv_id, c.turn, c.role, coalesce(cast(e.value as varchar), 'not yet run') <> 'not yet run' as run
from conversations c left join (select user_id, max(value) as value from events where event_type = 'purchase' group by user_id) e on c.conv_id = e.user_id
where c.role in ('user', 'system') and starts_with(c.role, 'u')""")
def j26(v):
    res = v.table("events").filter("event_type = 'purchase'").groupBy(F.col("user_id").alias("conv_id")).agg(F.max("value").alias("value"))
    q = v.table("conversations").filter(F.col("role").isin("user", "system") & F.col("role").startswith("u"))
    return q.join(res, "conv_id", "left").select("conv_id", "turn", "role", (F.coalesce(F.col("value").cast("string"), F.lit("not yet run")) != "not yet run").alias("run"))


@query("s18_resume_skip_done", """
select source, count(*) as n from documents where source not in (select source from documents where lang = 'de' group by source having count(*) >= 15) group by source""")
def s18(v):
    d = v.documents
    done = d.filter("lang = 'de'").groupBy("source").agg(F.count("*").alias("c")).filter("c >= 15").select("source")
    return RV.pending(d, done, "source").groupBy("source").agg(F.count("*").alias("n"))


@query("s19_merge_new_over_old", """
with old as (select place_id, term, pct, 'old' as origin from v_pop where kind = 'activity'),
     new as (select place_id, term, pct + 1 as pct, 'new' as origin from v_pop where kind = 'activity' and sentiment = 'positive')
select place_id, term, coalesce(new.pct, old.pct) as pct, coalesce(new.origin, old.origin) as origin from old full join new using (place_id, term)""")
def s19(v):
    act = v.pop.filter("kind = 'activity'").select("place_id", "term", "pct", "sentiment")
    old = act.select("place_id", "term", "pct", F.lit("old").alias("origin"))
    new = act.filter("sentiment = 'positive'").select("place_id", "term", (F.col("pct") + 1).alias("pct"), F.lit("new").alias("origin"))
    return RV.upsert(old, new, ["place_id", "term"])


@query("s20_group_delivered_items", """
with items as (select page_id, regexp_replace(url, '\\?.*$', '') as bare, html from pages),
     places as (select 'P' || page_id as place, regexp_replace(url, '\\?.*$', '') as bare from pages where url like '%?%')
select place, count(*) as n from items join places using (bare) where trim(html) <> '' group by place""")
def s20(v):
    pages = v.table("pages")
    items = pages.select(F.lit(None).cast("string").alias("item_place_id"), "url", F.col("html").alias("text"))
    places = pages.filter(F.col("url").contains("?")).select(F.concat(F.lit("P"), "page_id").alias("place"), F.lit(None).cast("string").alias("place_id"), "url")
    return RV.match_items(items, places).groupBy("place").agg(F.count("*").alias("n"))


@query("s2_s7_unified_flat_reviews", """
select doc_id as review_id, case when doc_id % 3 = 0 then 'A' else 'B' end as source_tag, coalesce(nullif(case when doc_id % 7 = 0 then '' else 'user' || (doc_id % 50) end, ''), '') as user_name,
  case when doc_id % 3 = 0 then source else coalesce(nullif(source, ''), 'file') end as place_name, 1 + doc_id % 5 as rating, '' as owner_response, doc_id % 9 as contributions from documents""")
def s2(v):
    d, i = v.documents, F.col("doc_id")
    user = F.when(i % 7 != 0, F.concat(F.lit("user"), (i % 50).cast("string")))
    a = RV.from_source_a(d.filter(i % 3 == 0).select(
        i.cast("string").alias("title"), F.col("text").alias("body"), (1 + i % 5).cast("int").alias("rating"), F.lit(None).cast("string").alias("date"),
        user.alias("reviewer"), (i % 9).cast("string").alias("contributions"), F.lit("").alias("reviewer_location"),
        F.lit("").alias("type_of_traveler"), F.col("source").alias("place_name"), F.lit("").alias("page_url")))
    b = d.filter(i % 3 != 0).select(i.cast("string").alias("title"), F.col("text"), (1 + i % 5).cast("int").alias("rating"), F.lit("").alias("url"),
                                    F.struct(user.alias("name"), F.struct((i % 9).alias("totalContributions")).alias("contributions")).alias("user"),
                                    F.struct(F.col("source").alias("name")).alias("placeInfo"), F.lit("B").alias("_source"))
    flat = RV.flatten(RV.union_sources(a, b), F.lit("file"))
    return flat.select(F.col("title").cast("bigint").alias("review_id"), F.col("_source").alias("source_tag"), "user_name", "place_name",
                       F.col("rating").cast("bigint").alias("rating"), "owner_response", F.col("contributions").cast("bigint").alias("contributions"))


@query("s10_json_arrays", f"""
select doc_id, len({_SENT.format(t="text")}) as n from documents where doc_id not in (select doc_id from documents where len({_SENT.format(t="text")}) = 0)""")
def s10(v):
    d = v.documents.select("doc_id", RV.array_as_json(X.sentences(F.col("text"))).alias("j"))
    return RV.explode_json(d, "j").groupBy("doc_id").agg(F.count("*").alias("n"))
