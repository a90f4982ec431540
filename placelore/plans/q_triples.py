"""Registered queries over place-term tables."""

from pyspark.sql import functions as F

from placelore.operators import triples as T
from placelore.plans.registry import query

POP_COLS = ["kind", "place_id", "term", "pct", "review_count", "total_reviews", "avg_confidence", "sentiment"]


@query("a14_popularity", """
select kind, place_id, term, pct, review_count, total_reviews, avg_confidence, sentiment from v_pop
where review_count * 100.0e0 / total_reviews >= 10 and review_count >= 5""")
def a14_popularity(v):
    return T.popular(v.pop).select(*POP_COLS)


@query("flagship_popular_terms", """
select * from (
  select place_id, term, pct, review_count, sentiment,
         row_number() over (partition by place_id order by pct desc, term) as rank
  from v_pop where kind = 'activity' and review_count * 100.0e0 / total_reviews >= 10 and review_count >= 5) where rank <= 5""")
def flagship(v):
    pop = T.popularity(v.mentions.filter("kind = 'activity'"), v.totals)
    top = T.top_per_place(T.popular(pop), [F.desc("pct"), F.col("term")])
    return top.select("place_id", "term", "pct", "review_count", "sentiment", "rank")


@query("a12_mention_counts", """
select kind, place_id, term, mentions, pos, neg, neu, sentiment as dominant,
       case when pos = greatest(pos, neg, neu) then 'positive' when neg = greatest(pos, neg, neu) then 'negative' else 'neutral' end as summary_dominant
from v_pop""")
def a12(v):
    p, n, u = F.col("pos"), F.col("neg"), F.col("neu")
    return T.mention_counts(v.mentions).select("kind", "place_id", "term", "mentions", "pos", "neg", "neu",
                                               T.dominant_sentiment(p, n, u).alias("dominant"),
                                               T.summary_sentiment(p, n, u).alias("summary_dominant"))


@query("j1_reviews_join", """
select kind, place_id, term, review_count, t.total_reviews from v_pop left join v_totals t using (place_id)
where t.total_reviews is not null""")
def j1(v):
    counts = T.mention_counts(v.mentions)
    return (counts.join(v.totals, "place_id", "left").dropna(subset=["total_reviews"])
            .select("kind", "place_id", "term", "review_count", "total_reviews"))


_TFIDF = """
with c as (select kind, place_id, term, mentions, conf_sum, review_count, total_reviews from v_pop{where}),
     x as (select c.*, sum(mentions) over (partition by kind, place_id) as pm,
                  count(*) over (partition by kind, term) as df from c),
     n as (select kind, count(distinct place_id) as n from c group by kind)
select x.kind, place_id, term, mentions, df as doc_freq, round(mentions / pm, 6) as tf, round(ln(n / df), 6) as idf,
       round(mentions / pm * ln(n / df) * conf_sum / (100 * mentions), 6) as defining_score
from x join n on x.kind = n.kind"""


def _scored(df):
    return df.select("kind", "place_id", "term", "mentions", F.col("df").alias("doc_freq"), F.round("tf", 6).alias("tf"),
                     F.round("idf", 6).alias("idf"), F.round("defining_score", 6).alias("defining_score"))


@query("a15_tf_idf", _TFIDF.format(where=""))
def a15(v):
    return _scored(T.tf_idf(T.mention_counts(v.mentions)))


@query("f4_noise_filter_tf_idf", _TFIDF.format(where=" where mentions >= 5 and conf_sum >= 75 * mentions"))
def f4(v):
    return _scored(T.tf_idf(T.noise_filter(T.mention_counts(v.mentions))))


@query("w1_top5_per_place", """
select * from (select kind, place_id, term, pct,
  row_number() over (partition by kind, place_id order by pct desc, term) as rank from v_pop) where rank <= 5""")
def w1(v):
    return T.top_per_place(v.pop, [F.desc("pct"), F.col("term")]).select("kind", "place_id", "term", "pct", "rank")


@query("j3_enrich_popular", """
with c as (select *, sum(mentions) over (partition by kind, place_id) as pm, count(*) over (partition by kind, term) as df from v_pop),
     n as (select kind, count(distinct place_id) as n from v_pop group by kind)
select c.kind, place_id, term, pct, round(mentions / pm, 6) as tf, round(ln(n / df), 6) as idf
from c join n on c.kind = n.kind where review_count * 100.0e0 / total_reviews >= 10 and review_count >= 5""")
def j3(v):
    scored = T.tf_idf(T.mention_counts(v.mentions)).select("kind", "place_id", "term", F.round("tf", 6).alias("tf"), F.round("idf", 6).alias("idf"))
    return T.popular(v.pop).select("kind", "place_id", "term", "pct").join(scored, T.KEYS, "left")


@query("a16_term_frequency", """
with p as (select * from v_pop where review_count * 100.0e0 / total_reviews >= 10 and review_count >= 5), n as (select kind, count(distinct place_id) as n from p group by kind)
select kind, lower(term) as term, count(distinct place_id) as df, round(count(distinct place_id) * 100 / any_value(n), 6) as freq_pct from p join n using (kind) group by kind, lower(term)""")
def a16(v):
    return T.term_frequency(T.popular(v.pop)).select("kind", "term", "df", F.round("freq_pct", 6).alias("freq_pct"))


@query("m16_dynamic_threshold", """
with p as (select * from v_pop where review_count * 100.0e0 / total_reviews >= 10 and review_count >= 5), n as (select kind, count(distinct place_id) as n from p group by kind),
 f as (select term, max(f) as f from (select lower(term) as term, count(distinct place_id) * 100 / any_value(n) as f from p join n using (kind) group by kind, lower(term)) group by term),
 w as (select qid, lower(activity) as term from v_questions union all select qid, lower(feature) from v_questions),
 r as (select qid, least(min(coalesce(f, 0)), 100) as m from w left join f on w.term = f.term group by qid)
select qid, round(m, 6) as min_freq, case when m >= 30 then 20 when m <= 5 then 0 else round(pow((m - 5) / 25, 2) * 20, 2) end as threshold from r""")
def m16(v):
    wanted = v.questions.select("qid", F.explode(F.array("activity", "feature")).alias("term"))
    return T.query_thresholds(wanted, T.term_frequency(T.popular(v.pop))).select("qid", F.round("min_freq", 6).alias("min_freq"), "threshold")


@query("j14_similar_places", """
with t as (select distinct place_id, term from v_pop where kind = 'feature' and review_count * 100.0e0 / total_reviews >= 10 and review_count >= 5)
select a.place_id as place_a, b.place_id as place_b, count(*) as n_shared, string_agg(a.term, '|' order by a.term) as shared
from t a join t b on a.term = b.term and a.place_id < b.place_id group by 1, 2 having count(*) >= 3""")
def j14(v):
    return T.similar_places(T.popular(v.pop).filter("kind = 'feature'").select("place_id", "term"))


@query("a39_extraction_report", """
select 'total' as section, item, n from (
  select count(*) as triples, count(distinct place_id) as places, count(distinct term) as terms, count(distinct evidence_id) as reviews_with
  from v_mentions where kind = 'activity') unpivot (n for item in (triples, places, terms, reviews_with))
union all select 'sentiment', sentiment, count(*) from v_mentions where kind = 'activity' group by sentiment
union all (select 'top_term', term, count(*) as n from v_mentions where kind = 'activity' group by term order by n desc, term limit 20)
union all (select 'top_place', cast(place_id as varchar), count(*) as n from v_mentions where kind = 'activity' group by place_id order by n desc, cast(place_id as varchar) limit 20)""")
def a39(v):
    return T.extraction_report(v.mentions.filter("kind = 'activity'"), v.totals)


@query("a39_reviews_without_terms", """
select o_orderkey as review_id from orders where not exists (select 1 from v_mentions where evidence_id = o_orderkey and sentiment = 'positive')""")
def a39b(v):
    hit = v.mentions.filter("sentiment = 'positive'").select(F.col("evidence_id").alias("review_id")).distinct()
    return v.table("orders").select(F.col("o_orderkey").alias("review_id")).join(hit, "review_id", "left_anti")


@query("a42_feature_sentiment", """
select term, sentiment, count(*) as n from v_pop where kind = 'feature' group by term, sentiment""")
def a42(v):
    return v.pop.filter("kind = 'feature'").groupBy("term", "sentiment").agg(F.count("*").alias("n"))


@query("s14_evidence_documents", """
select kind, place_id, term, count(*) as n_ids, min(evidence_id) as first_id, max(evidence_id) as last_id
from (select distinct kind, place_id, term, evidence_id from v_mentions) group by kind, place_id, term""")
def s14(v):
    docs = T.evidence_documents(v.mentions, v.pop)
    ids = F.from_json("document", "evidence_ids array<bigint>")["evidence_ids"]
    back = docs.select(*T.KEYS, F.size(ids).alias("n"), F.array_min(ids).alias("lo"), F.array_max(ids).alias("hi"))
    return back.groupBy(*T.KEYS).agg(F.sum("n").alias("n_ids"), F.min("lo").alias("first_id"), F.max("hi").alias("last_id"))


@query("s16_ranked_terms", """
select kind, place_id, string_agg(term || ':' || cast(round(pct, 1) as varchar) || ':' || sentiment, '|' order by round(pct, 1) desc, term) as items
from v_pop group by kind, place_id""")
def s16(v):
    r = T.ranked_terms(v.pop)
    return r.select("kind", "place_id", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["name"], x["pct"].cast("string"), x["sentiment"])), "|").alias("items"))


@query("a44_graph_counts", """
select kind || ' nodes' as item, count(distinct term) as n from v_pop group by kind
union all select kind || ' edges', count(*) from v_pop group by kind
union all select 'places', count(*) from v_places""")
def a44(v):
    k = v.pop.groupBy("kind").agg(F.countDistinct("term").alias("nodes"), F.count("*").alias("edges"))
    rows = k.select(F.inline(F.array(F.struct(F.concat("kind", F.lit(" nodes")).alias("item"), F.col("nodes").alias("n")),
                                     F.struct(F.concat("kind", F.lit(" edges")).alias("item"), F.col("edges").alias("n")))))
    return rows.unionByName(v.places.agg(F.count("*").alias("n")).select(F.lit("places").alias("item"), "n"))
