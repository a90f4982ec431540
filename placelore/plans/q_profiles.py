"""Registered queries over normalized reviews and place profiles."""

from pyspark.sql import functions as F

from placelore.functions import normalize as N
from placelore.functions import rules as R
from placelore.functions.numbers import sql_ratio
from placelore.operators import profiles as PR
from placelore.plans.q_text import _SENT, _tag_sql
from placelore.plans.registry import query
from placelore.plans.sqltext import any_match, first_label, lit
from placelore.session import durable, stored
from placelore.sources import proxies
from placelore.sources.proxies import VIEW_SQL


def _pos(label_patterns):
    return "coalesce(" + ", ".join(f"case when regexp_matches(low, {lit(p)}) then length(regexp_extract(low, {lit('(?s)^(.*?)(?:' + p + ')')}, 1)) + 1 end" for p in label_patterns) + ")"


_POS = ", ".join(f"{_pos(ps)} as pos_{k}" for k, ps in R.TIME_OF_DAY)
_NEG = ", ".join(f"regexp_matches(substr(low, greatest(pos_{k} - 16, 1), pos_{k} - greatest(pos_{k} - 16, 1)), {lit(R.TIME_NEGATION)}) as neg_{k}" for k, _ in R.TIME_OF_DAY)
_n = lambda k: f"coalesce(neg_{k}, false)"
_TOD = ("case " + " ".join(f"when not neg_{k} then {lit(k)}" for k in R.TIME_PREFERENCE)
        + f" when regexp_matches(low, {lit(R.HEAT)}) and ({_n('AFTERNOON')} or {_n('MID_MORNING')} or {_n('NIGHT')}) then 'EARLY_MORNING' when {_n('AFTERNOON')} then 'EVENING' when {_n('EVENING')} or {_n('NIGHT')} then 'EARLY_MORNING' end")
_BAD = f"regexp_matches(low, {lit(R.DAY_AVOID)})"
_HOL = f"regexp_matches(low, {lit(R.HOLIDAY)})"
_WE, _WD = "regexp_matches(low, '\\bweekend')", "regexp_matches(low, '\\bweek\\s?day')"
_CROWD = first_label("low", R.CROWD_LEVELS)
_AMT = f"""list_reduce(list_concat([{{'at': 1, 'm': '', 'best': [null, null, null]::bigint[]}}], list_transform(regexp_extract_all(low, {lit(R.AMOUNT)}, 0), lambda m: {{'at': 0, 'm': m, 'best': [null, null, null]::bigint[]}})),
  lambda acc, x: {{'at': acc.at + instr(substr(low, acc.at), x.m) - 1 + length(x.m), 'm': '',
    'best': [coalesce(acc.best[1], case when regexp_matches(substr(low, greatest(acc.at + instr(substr(low, acc.at), x.m) - 1 - 18, 1), acc.at + instr(substr(low, acc.at), x.m) - 1 + length(x.m) + 22 - greatest(acc.at + instr(substr(low, acc.at), x.m) - 1 - 18, 1)), {lit(R.AMOUNT_FOREIGN)}) then AMT(x.m) end),
             coalesce(acc.best[2], case when not regexp_matches(substr(low, greatest(acc.at + instr(substr(low, acc.at), x.m) - 1 - 18, 1), acc.at + instr(substr(low, acc.at), x.m) - 1 + length(x.m) + 22 - greatest(acc.at + instr(substr(low, acc.at), x.m) - 1 - 18, 1)), {lit(R.AMOUNT_LOCAL)}) then AMT(x.m) end),
             coalesce(acc.best[3], AMT(x.m))]}}).best""".replace(
    "AMT(x.m)", "(case when regexp_matches(x.m, '\\$|usd|dollar') then cast(floor(try_cast(replace(regexp_extract(x.m, '\\d[\\d,.]*', 0), ',', '') as double) * 300) as bigint) else try_cast(regexp_extract(replace(regexp_extract(x.m, '\\d[\\d,.]*', 0), ',', ''), '^\\d+', 0) as bigint) end)")

VIEW_SQL["v_norm"] = f"""
 select *, coalesce(amount_level, opinion_level) as cost_level from (
  select *, case when amount_lkr = 0 then 'FREE' when amount_lkr < 500 then 'LOW' when amount_lkr < 1500 then 'MODERATE' when amount_lkr < 5000 then 'HIGH' when amount_lkr is not null then 'VERY_HIGH' end as amount_level from (
   select review_id, place_id, rating, travel_date, text, low, score, {_TOD} as time_of_day, {first_label('low', R.SEASON)} as season,
    list_filter([{", ".join(f"case when regexp_matches(low, '\\b{m}\\b') then '{m.upper()}' end" for m in R.MONTHS)}], lambda x: x is not null) as months,
    coalesce(case when {_WE} then case when {_BAD} then 'WEEKDAY' else 'WEEKEND' end when {_WD} then case when {_BAD} then 'WEEKEND' else 'WEEKDAY' end end, case when {_HOL} then case when {_BAD} then 'WEEKDAY' else 'PUBLIC_HOLIDAY' end end) as recommend_day,
    list_filter([case when {_BAD} and {_HOL} then 'PUBLIC_HOLIDAY' end, case when {_BAD} and not {_WE} and {_WD} then 'WEEKDAY' end, case when {_BAD} and {_WE} then 'WEEKEND' end], lambda x: x is not null) as avoid,
    case when {_CROWD} >= 3 and regexp_matches(low, {lit(R.CROWD_NEGATION)}) then 2 else {_CROWD} end as crowd_level,
    list_filter([{", ".join(f"case when {any_match('low', ps)} then {lit(k)} end" for k, ps in R.DAY_TYPE)}], lambda x: x is not null) as crowd_when,
    coalesce(amt[1], amt[2], amt[3]) as amount_lkr, {first_label('low', R.COST_OPINION)} as opinion_level,
    case {" ".join("when " + " or ".join(f"contains(low, {lit(w)})" for w in ws) + f" then {lit(k)}" for k, ws in R.FEE_WORDS)} end as fee_type,
    case regexp_extract(low, {lit(chr(92) + 'b(' + '|'.join(R.EVALUATION_WORDS) + ')' + chr(92) + 'b')}, 1) {" ".join(f"when {lit(k)} then {lit(x)}" for k, x in R.EVALUATION_WORDS.items())} end as evaluation,
    {_tag_sql('best_time', 'text')} as tag_best_time, {_tag_sql('crowd_level', 'text')} as tag_crowd, {_tag_sql('cost_level', 'text')} as tag_cost
   from (select *, {_NEG} from (select *, {_POS}, {_AMT} as amt from (select *, lower(text) as low, 1 - l_discount as score from v_notes)))))"""

VIEW_SQL["v_votes"] = """
 select place_id, aspect, value, count(*) as n from (
  select place_id, 'time_of_day' as aspect, time_of_day as value from v_norm where tag_best_time union all select place_id, 'season', season from v_norm where tag_best_time
  union all select place_id, 'month', unnest(months) from v_norm where tag_best_time union all select place_id, 'avoid', unnest(avoid) from v_norm where tag_best_time
  union all select place_id, 'recommend', recommend_day from v_norm where tag_best_time
  union all select place_id, 'crowd', cast(crowd_level as varchar) from v_norm where tag_crowd union all select place_id, 'when', unnest(crowd_when) from v_norm where tag_crowd
  union all select place_id, 'cost', cost_level from v_norm where tag_cost union all select place_id, 'amount_level', amount_level from v_norm where tag_cost
  union all select place_id, 'opinion', opinion_level from v_norm where tag_cost union all select place_id, 'fee', fee_type from v_norm where tag_cost) where value is not null group by all"""
VIEW_SQL["v_dom"] = "select *, row_number() over (partition by place_id, aspect order by n desc, value) as rn, cast(sum(n) over (partition by place_id, aspect) as bigint) as total from v_votes"
_top = lambda a: f"max(value) filter (aspect = '{a}' and rn = 1)"
_conf = lambda a: f"max({sql_ratio('n', 'total', 2)}) filter (aspect = '{a}' and rn = 1)"
_list = lambda a, k: f"coalesce(string_agg(value, '|' order by rn) filter (aspect = '{a}' and rn <= {k}), '')"
VIEW_SQL["v_profiles"] = f"""
 select b.*, time_of_day, season, months, avoid, case when time_based_on > 0 then coalesce(tc, 0) end as time_confidence, crowd_level, avg_level, busiest, crowd_confidence, modal_level, cost_level, amount_level, opinion_level, fee_type, cost_confidence,
   case when cost_level is not null then median_lkr end as median_lkr, ['EMPTY', 'QUIET', 'MODERATE', 'BUSY', 'PACKED'][crowd_level] as crowd_label
 from (select place_id, count(*) as total_reviews, count(*) filter (tag_best_time) as time_based_on, count(*) filter (tag_crowd) as crowd_based_on, count(*) filter (tag_cost) as cost_based_on from v_norm group by place_id) b
 left join (select place_id, {_top('time_of_day')} as time_of_day, {_top('season')} as season, {_list('month', 6)} as months, {_list('avoid', 99)} as avoid, {_conf('time_of_day')} as tc, max(try_cast(value as int)) filter (aspect = 'crowd') as crowd_level,
   {sql_ratio("cast(sum(case when aspect = 'crowd' then try_cast(value as int) * n end) as bigint)", "cast(sum(n) filter (aspect = 'crowd') as bigint)", 1)} as avg_level, {_list('when', 3)} as busiest, {_conf('crowd')} as crowd_confidence, {_top('crowd')} as modal_level,
   {_top('cost')} as cost_level, {_top('amount_level')} as amount_level, {_top('opinion')} as opinion_level, {_top('fee')} as fee_type, {_conf('cost')} as cost_confidence from v_dom group by place_id) p using (place_id)
 left join (select place_id, percentile_disc(0.5) within group (order by amount_lkr desc) as median_lkr from v_norm where tag_cost and amount_lkr is not null group by place_id) using (place_id)"""
PROFILE_COLS = ["place_id", "total_reviews", "time_based_on", "crowd_based_on", "cost_based_on", "time_of_day", "season", "months", "avoid", "time_confidence", "crowd_level", "crowd_label", "avg_level",
                "busiest", "crowd_confidence", "cost_level", "amount_level", "opinion_level", "fee_type", "cost_confidence", "median_lkr"]


def norm(v):
    return N.normalized(v.notes.withColumn("score", 1 - F.col("l_discount")))


def profile(v):
    return PR.profiles(norm(v))


proxies.Views.norm = property(norm)
proxies.Views.profiles = property(profile)
_join = lambda c: F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c)


@query("m1_m8_normalized_values", """select review_id, place_id, rating, count(*) as n, min(time_of_day) as time_of_day, min(season) as season, min(array_to_string(months, '|')) as months, min(recommend_day) as recommend_day, min(array_to_string(avoid, '|')) as avoid,
 min(crowd_level) as crowd_level, min(array_to_string(crowd_when, '|')) as crowd_when, min(amount_lkr) as amount_lkr, min(amount_level) as amount_level, min(opinion_level) as opinion_level, min(cost_level) as cost_level, min(fee_type) as fee_type, min(evaluation) as evaluation
 from v_norm group by review_id, place_id, rating""")
def m1(v):
    n = v.norm
    for c in ("months", "avoid", "crowd_when"):
        n = n.withColumn(c, F.array_join(c, "|"))
    return n.groupBy("review_id", "place_id", "rating").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in (
        "time_of_day", "season", "months", "recommend_day", "avoid", "crowd_level", "crowd_when", "amount_lkr", "amount_level", "opinion_level", "cost_level", "fee_type", "evaluation")])


@query("a7_a10_place_profiles", "select " + ", ".join(PROFILE_COLS) + " from v_profiles")
def a10(v):
    p = v.profiles
    return p.select(*[_join(c) if c in ("months", "avoid", "busiest") else c for c in PROFILE_COLS])


@query("a4_a5_dominant_values", f"select place_id, aspect, value, n, {sql_ratio('n', 'total', 2)} as agreement from v_dom where rn = 1")
def a4(v):
    d = PR.dominant(PR.votes(v.norm), ["place_id", "aspect"]).filter("rn = 1")
    return d.select("place_id", "aspect", "value", "n", PR.ratio(F.col("n"), F.col("total"), 2).alias("agreement"))


@query("a6_upper_median", "select place_id, percentile_disc(0.5) within group (order by amount_lkr desc) as median from v_norm where amount_lkr is not null group by place_id")
def a6(v):
    return PR.upper_median(v.norm.filter("amount_lkr is not null"), ["place_id"], "amount_lkr")


@query("a11_value_distributions", """with d as (select place_id, case when aspect = 'recommend' then 'avoid' else aspect end as aspect, case when aspect = 'recommend' then 'RECOMMEND_' || value else value end as value, n from v_votes)
select place_id, aspect, string_agg(value || '=' || n, '|' order by value) as dist from d group by place_id, aspect""")
def a11(v):
    m = PR.distribution_maps(PR.value_distributions(v.norm))
    return m.select("place_id", "aspect", F.array_join(F.transform(F.map_entries("dist"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|").alias("dist"))


@query("a2_a3_tag_report", f"""with c as (select coalesce(cast(place_id as varchar), '(all)') as place_id, count(*) as reviews, count(*) filter (tag_best_time or tag_crowd or tag_cost) as any_tag, count(*) filter (tag_best_time) as n_best_time,
  count(*) filter (tag_crowd) as n_crowd_level, count(*) filter (tag_cost) as n_cost_level, {", ".join(f"cast(coalesce(sum(cast(round(score * 10000) as bigint)) filter ({t}), 0) as bigint) as s_{k}" for k, t in PR.TAG.items())} from v_norm group by grouping sets ((place_id), ()))
select place_id, reviews, any_tag, n_best_time, n_crowd_level, n_cost_level, {", ".join(f"{sql_ratio(f'n_{k}', 'reviews', 4)} as rate_{k}" for k in PR.TAG)}, {", ".join(f"coalesce({sql_ratio(f's_{k}', f'(n_{k} * 10000)', 4)}, 0) as avg_{k}" for k in PR.TAG)} from c""")
def a2(v):
    return PR.tag_report(v.norm)


def _evidence_sql(cat, tag, value, dom):
    first = f"list_filter({_SENT.format(t='text')}, lambda s: {_tag_sql(cat, 's')})[1]"
    return f"""with e as (select n.place_id, review_id, rating, score, {first} as sentence, coalesce(case when cast(n.{value} as varchar) = p.{dom} then 1 end, 0) as agrees from v_norm n join v_profiles p on n.place_id = p.place_id where {tag}),
 a as (select *, row_number() over (partition by place_id, lower(sentence)[1:120] order by agrees desc, score desc, review_id) as r1 from e where sentence is not null),
 b as (select *, row_number() over (partition by place_id order by agrees desc, score desc, review_id) as rank from a where r1 = 1)
select place_id, rank, sentence, agrees, round(score, 4) as score from b where rank <= 10"""


for _c, _t, _v, _d in (("best_time", "tag_best_time", "time_of_day", "time_of_day"), ("crowd_level", "tag_crowd", "crowd_level", "modal_level"), ("cost_level", "tag_cost", "cost_level", "cost_level")):
    @query(f"w2_evidence_{_c}", _evidence_sql(_c, _t, _v, _d))
    def w2(v, cat=_c):
        n = stored(v.norm)  # read for the profile and for the evidence
        e = PR.evidence(n, PR.profiles(n), cat)
        return e.select("place_id", F.col("rank").cast("bigint").alias("rank"), "sentence", F.col("agrees").cast("bigint").alias("agrees"), F.round("score", 4).alias("score"))


@query("s11_span_rows", """with r as (select place_id, 'best_time' as category, coalesce(time_of_day, '') as value, array_to_string(months, '|') as detail from v_norm where tag_best_time
 union all select place_id, 'crowd_level', coalesce(cast(crowd_level as varchar), ''), array_to_string(crowd_when, '|') from v_norm where tag_crowd
 union all select place_id, 'cost_level', coalesce(cost_level, ''), coalesce(cast(amount_lkr as varchar), '') from v_norm where tag_cost) select place_id, category, value, count(*) as n, count(distinct detail) as details from r group by all""")
def s11(v):
    return PR.span_rows(v.norm).groupBy("place_id", "category", "value").agg(F.count("*").alias("n"), F.countDistinct("detail").alias("details"))


@query("s13_publish_profiles", """with p as (select place_id, case when place_id % 9 = 0 then 'Nowhere ' || place_id else upper(s_name) end as place_name, time_of_day, median_lkr from v_profiles join supplier on s_suppkey = place_id)
select place_id, coalesce(s_name, '(skipped)') as listed_name, time_of_day, median_lkr from p left join supplier on lower(s_name) = lower(place_name)""")
def s13(v):
    names = v.places.select("place_id", F.when(F.col("place_id") % 9 == 0, F.concat(F.lit("Nowhere "), F.col("place_id").cast("string"))).otherwise(F.upper("place_name")).alias("place_name"))
    p = durable(v.profiles.select("place_id", "time_of_day", "median_lkr").join(names, "place_id"))  # read for the hits and for the misses
    hit, miss = PR.publish(p, v.places)
    cols = ["place_id", "listed_name", "time_of_day", "median_lkr"]
    return hit.select(*cols).unionByName(miss.withColumn("listed_name", F.lit("(skipped)")).select(*cols))


@query("s8_s9_tables_and_stats", """select 'all' as tbl, cast(place_id as varchar) as place_id, count(*) as n from v_norm group by place_id
 union all select 'crowd_level', cast(place_id as varchar), count(*) from v_norm where tag_crowd group by place_id
 union all select 'stats', '(all)', count(distinct place_id) from v_norm""")
def s8(v):
    from placelore.sources import sinks

    n = stored(v.norm.select("place_id", "score", "tag_best_time", "tag_crowd", "tag_cost"))  # read for each table
    count = lambda name, df: df.groupBy(F.col("place_id").cast("string").alias("place_id")).agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "place_id", "n")
    lines = sinks.stats_lines(PR.tag_report(n)).filter(F.get_json_object("doc", "$.place_id") != "(all)")
    return (count("all", n).unionByName(count("crowd_level", sinks.category_tables(n)["crowd_level"]))
            .unionByName(lines.agg(F.count("*").alias("n")).select(F.lit("stats").alias("tbl"), F.lit("(all)").alias("place_id"), "n")))
