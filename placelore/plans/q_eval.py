"""Registered queries for evaluation metrics."""

from pyspark.sql import functions as F

from placelore.functions.numbers import sql_ratio as R
from placelore.operators import evaluate as E
from placelore.plans.registry import query
from placelore.sources.proxies import VIEW_SQL

VIEW_SQL["v_gold"] = """select doc_id, source, lang, quality = 1 as truth, n_chars > 1000 as pred, toxic from documents join labels using (doc_id)"""
VIEW_SQL["v_bin"] = """select lang, count(*) filter (truth and pred) as tp, count(*) filter (not truth and pred) as fp, count(*) filter (truth and not pred) as fn, count(*) filter (not truth and not pred) as tn from v_gold group by lang"""
VIEW_SQL["v_met"] = f"""select *, case when p + r > 0 then (2 * 2 * p * r + (p + r)) // (2 * (p + r)) else 0 end as f from (
  select *, coalesce((2 * tp * 10000 + (tp + fp)) // nullif(2 * (tp + fp), 0), 0) as p, coalesce((2 * tp * 10000 + (tp + fn)) // nullif(2 * (tp + fn), 0), 0) as r from v_bin)"""
VIEW_SQL["v_cat"] = """select l_returnflag as field, ['DRY', 'WET', 'NONE', ''][1 + l_partkey % 4] as t0, ['DRY', 'WET', ''][1 + (l_partkey + l_linenumber) % 3] as p0 from lineitem"""
VIEW_SQL["v_ordinal"] = """select l_shipdate, l_returnflag as field, case when l_linenumber = 7 then 'ABSTAIN' else cast(1 + cast(l_quantity as int) % 5 as varchar) end as t, cast(1 + (cast(l_quantity as int) + l_linenumber) % 5 as varchar) as p from lineitem"""


def gold(v):
    d = v.table("documents").select("doc_id", "source", "lang", "n_chars").join(v.table("labels"), "doc_id")
    return d.select("doc_id", "source", "lang", (F.col("quality") == 1).alias("truth"), (F.col("n_chars") > 1000).alias("pred"), "toxic")


def _tp():
    return F.col("truth"), F.col("pred")


@query("a18_binary_metrics", f"""select lang, tp, fp, fn, tn, p / 1e4 as precision, r / 1e4 as recall, f / 1e4 as f1, {R('tp + tn', 'tp + fp + fn + tn', 4)} as accuracy, tp + fn as support from v_met""")
def a18(v):
    return E.binary_metrics(E.binary_counts(gold(v), ["lang"], *_tp())).select("lang", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "accuracy", "support")


@query("a19_macro", """with m as (select cast((2 * sum(p) + count(*)) // (2 * count(*)) as bigint) as p, cast((2 * sum(r) + count(*)) // (2 * count(*)) as bigint) as r from v_met)
select p / 1e4 as macro_precision, r / 1e4 as macro_recall, case when p + r > 0 then ((2 * 2 * p * r + (p + r)) // (2 * (p + r))) / 1e4 else 0 end as macro_f1 from m""")
def a19(v):
    return E.macro(E.binary_metrics(E.binary_counts(gold(v), ["lang"], *_tp())))


@query("a20_error_examples", """select doc_id, lang, error, rn from (select *, row_number() over (partition by lang, error order by doc_id) as rn from (
  select doc_id, lang, case when not truth and pred then 'FP' when truth and not pred then 'FN' end as error from v_gold) where error is not null) where rn <= 5""")
def a20(v):
    return E.error_examples(gold(v), ["lang"], *_tp(), ["doc_id"]).select("doc_id", "lang", "error", F.col("rn").cast("bigint").alias("rn"))


def _cat(v):
    pick = lambda values, i: F.get(F.array(*[F.lit(x) for x in values]), i.cast("int"))
    return v.table("lineitem").select(F.col("l_returnflag").alias("field"), pick(["DRY", "WET", "NONE", ""], F.col("l_partkey") % 4).alias("t0"),
                                      pick(["DRY", "WET", ""], (F.col("l_partkey") + F.col("l_linenumber")) % 3).alias("p0"))


_CONF = "select field, coalesce(nullif(trim(t0), ''), 'NOT_STATED') as true_label, coalesce(nullif(trim(p0), ''), 'NOT_STATED') as pred_label, count(*) as n from v_cat group by all"


@query("a22_confusion", _CONF)
def a22(v):
    return E.confusion(_cat(v), ["field"], "t0", "p0")


@query("a21_categorical_metrics", f"""
with c as ({_CONF}), l as (select field, label, sum(tp) as tp, sum(nt) as nt, sum(np) as np from (select field, true_label as label, case when true_label = pred_label then n else 0 end as tp, n as nt, 0 as np from c
   union all select field, pred_label, 0, 0, n from c) group by field, label),
 f as (select field, round(avg(case when nt + np > 0 then 2 * tp / (nt + np) else 0 end), 6) as macro_f1 from l group by field),
 t as (select field, cast(sum(n) as bigint) as n, cast(coalesce(sum(n) filter (true_label = pred_label), 0) as bigint) as hit, cast(sum(n) filter (pred_label <> 'NOT_STATED') as bigint) as pr,
   cast(coalesce(sum(n) filter (pred_label <> 'NOT_STATED' and true_label = pred_label), 0) as bigint) as ph from c group by field)
select field, n, {R('hit', 'n', 4)} as accuracy, macro_f1, {R('pr', 'n', 4)} as coverage, {R('n - pr', 'n', 4)} as abstention, {R('ph', 'pr', 4)} as accuracy_when_produced from t join f using (field)""")
def a21(v):
    return E.categorical_metrics(E.confusion(_cat(v), ["field"], "t0", "p0"), ["field"])


def _ordinal(v):
    q = F.col("l_quantity").cast("int")
    return v.table("lineitem").select(F.col("l_returnflag").alias("field"), F.when(F.col("l_linenumber") == 7, "ABSTAIN").otherwise((1 + q % 5).cast("string")).alias("t"),
                                      (1 + (q + F.col("l_linenumber")) % 5).cast("string").alias("p"))


@query("a23_ordinal_metrics", f"""select field, n, scored, {R('hit', 'scored', 4)} as exact, {R('err', 'scored', 4)} as mae, {R('near', 'scored', 4)} as within_one from (
 select field, count(*) as n, count(d) as scored, count(*) filter (d = 0) as hit, cast(sum(d) as bigint) as err, count(*) filter (d <= 1) as near from (select *, abs(try_cast(t as int) - try_cast(p as int)) as d from v_ordinal) group by field)""")
def a23(v):
    return E.ordinal_metrics(_ordinal(v), ["field"], F.col("t"), F.col("p"))


@query("a24_amount_metrics", f"""
with x as (select l_returnflag as field, try_cast(replace(case when l_linenumber = 1 then '' else '1,' || lpad(cast(l_partkey % 100 as varchar), 3, '0') end, ',', '') as bigint) as t,
   try_cast(case when l_linenumber = 2 then 'none' else cast(1000 + (l_partkey + l_suppkey % 2) % 100 as varchar) end as bigint) as p from lineitem)
select field, n, {R('hit', 'n', 4)} as exact, {R('given', 'n', 4)} as coverage from (select field, count(*) as n, count(*) filter (t = p) as hit, count(p) as given from x where t is not null group by field)""")
def a24(v):
    pk = F.col("l_partkey")
    x = v.table("lineitem").select(F.col("l_returnflag").alias("field"),
                                   F.when(F.col("l_linenumber") == 1, "").otherwise(F.concat(F.lit("1,"), F.lpad((pk % 100).cast("string"), 3, "0"))).alias("t"),
                                   F.when(F.col("l_linenumber") == 2, "none").otherwise((1000 + (pk + F.col("l_suppkey") % 2) % 100).cast("string")).alias("p"))
    return E.amount_metrics(x, ["field"], F.col("t"), F.col("p"))


def _kappa_sql(src, where, weight):
    return f"""
with x as (select * from {src} where {where}), c as (select field, t as a, p as b, count(*) as c from x group by all),
 ma as (select field, a, sum(c) as c from c group by all), mb as (select field, b, sum(c) as c from c group by all),
 o as (select field, cast(sum(c) as bigint) as n, cast(coalesce(sum(c) filter (a = b), 0) as bigint) as same, sum(c * {weight}) as wo from c group by field),
 e as (select ma.field, sum({weight} * ma.c * mb.c) as we from ma join mb using (field) group by ma.field)
select field, n, {R('same', 'n', 4)} as agreement, round(case when we = 0 then 1 else 1 - wo / (we / n) end, 6) as kappa from o join e using (field)"""


@query("a25_kappa", _kappa_sql("(select field, t0 as t, p0 as p from v_cat)", "trim(t) <> '' and trim(p) <> ''", "(case when a = b then 0 else 1 end)"))
def a25(v):
    return E.kappa(_cat(v), ["field"], F.col("t0"), F.col("p0"))


@query("a25_quadratic_kappa", _kappa_sql("v_ordinal", "regexp_matches(t, '^[0-9]+$') and regexp_matches(p, '^[0-9]+$')", "pow(cast(a as double) - cast(b as double), 2)"))
def a25q(v):
    return E.kappa(_ordinal(v), ["field"], F.col("t"), F.col("p"), quadratic=True)


@query("j12_annotator_pairs", """select l.doc_id, quality as a1, toxic as a2, quality = toxic as same from labels l join documents d on d.doc_id = l.doc_id where d.text is not null""")
def j12(v):
    a = v.table("labels").select("doc_id", F.col("quality").alias("a1"))
    b = v.table("labels").select("doc_id", F.col("toxic").alias("a2"))
    return a.join(b, "doc_id").withColumn("same", F.col("a1") == F.col("a2"))


_SWEEP = f"""
with x as (select l_returnflag as field, l_linestatus = 'O' as truth, cast(round(l_discount * 100) as bigint) + cast(round(l_tax * 100) as bigint) as s from lineitem),
 g as (select field, k, count(*) filter (s >= k and truth) as tp, count(*) filter (s >= k and not truth) as fp, count(*) filter (s < k and truth) as fn, count(*) filter (s < k and not truth) as tn
   from x, (select unnest(generate_series(0, 18)) as k) group by field, k),
 m as (select *, coalesce((2 * tp * 10000 + (tp + fp)) // nullif(2 * (tp + fp), 0), 0) as p, coalesce((2 * tp * 10000 + (tp + fn)) // nullif(2 * (tp + fn), 0), 0) as r from g),
 sw as (select field, k / 100e0 as threshold, tp, fp, fn, p / 1e4 as precision, r / 1e4 as recall, case when p + r > 0 then ((2 * 2 * p * r + (p + r)) // (2 * (p + r))) / 1e4 else 0 end as f1 from m)"""


def _sweep(v):
    s = (F.round(F.col("l_discount") * 100) + F.round(F.col("l_tax") * 100)) / 100
    x = v.table("lineitem").select(F.col("l_returnflag").alias("field"), (F.col("l_linestatus") == "O").alias("truth"), s.alias("s"))
    return E.threshold_sweep(x, ["field"], F.col("s"), F.col("truth"), 0.0, 0.01, 18)


@query("a26_threshold_sweep", _SWEEP + " select * from sw")
def a26(v):
    return _sweep(v).select("field", "threshold", "tp", "fp", "fn", "precision", "recall", "f1")


@query("a27_a28_best_threshold", _SWEEP + " select field, threshold, f1, f1 = max(f1) over () as winner from (select *, row_number() over (partition by field order by f1 desc, threshold) as rn from sw) where rn = 1")
def a27(v):
    best = E.best_threshold(_sweep(v), ["field"]).select("field", "threshold", "f1")
    top = best.groupBy(F.lit(1).alias("k")).agg(F.max("f1").alias("top"))
    return best.withColumn("k", F.lit(1)).join(top, "k").select("field", "threshold", "f1", (F.col("f1") == F.col("top")).alias("winner"))


@query("a29_majority_baseline", f"""with c as (select field, t0, count(*) as n from v_cat where trim(t0) <> '' group by all)
select field, t0 as majority, n, total, {R('n', 'total', 4)} as accuracy from (select *, cast(sum(n) over (partition by field) as bigint) as total, row_number() over (partition by field order by n desc, t0) as rn from c) where rn = 1""")
def a29(v):
    return E.majority(_cat(v), ["field"], "t0")


VIEW_SQL["v_scores"] = "select event_type as setup, user_id as id, case when event_id % 11 = 0 then null else value end as metric, cast(event_id % 37 as double) as seconds, case when event_id % 5 = 0 then null else 'intent ' || (event_id % 3) end as expected, 'my intent ' || (user_id % 3) as detected from events"


def _scores(v):
    e = F.col("event_id")
    return v.table("events").select(F.col("event_type").alias("setup"), F.col("user_id").alias("id"), F.when(e % 11 != 0, F.col("value")).alias("metric"), (e % 37).cast("double").alias("seconds"),
                                    F.when(e % 5 != 0, F.concat(F.lit("intent "), (e % 3).cast("string"))).alias("expected"), F.concat(F.lit("my intent "), (F.col("user_id") % 3).cast("string")).alias("detected"))


_SUM = """select setup, count(*) as total, count(metric) as answered, round(avg(metric), 6) as mean, min(metric) as min, max(metric) as max, round(stddev_samp(metric), 6) as std, round(avg(seconds), 6) as avg_seconds from v_scores group by setup"""


@query("a30_score_summary", _SUM)
def a30(v):
    return E.score_summary(_scores(v), ["setup"], "metric", "seconds")


@query("a32_deltas", f"with s as ({_SUM}) select s.*, round(mean - (select mean from s where setup = 'view'), 6) as delta, (select arg_max(setup, mean) from s) as best_setup from s")
def a32(v):
    return E.deltas(E.score_summary(_scores(v), ["setup"], "metric", "seconds"), "setup", "view")


@query("a31_m27_intent_accuracy", f"""select setup, n, {R('hit', 'n', 4)} as accuracy from (select setup, count(*) as n, count(*) filter (contains(lower(detected), lower(expected))) as hit from v_scores where expected is not null group by setup)""")
def a31(v):
    s = _scores(v).filter("expected is not null and detected is not null")
    g = s.groupBy("setup").agg(F.count("*").alias("n"), F.count_if(F.contains(F.lower("detected"), F.lower("expected"))).alias("hit"))
    return g.select("setup", "n", E.ratio(F.col("hit"), F.col("n"), 4).alias("accuracy"))


@query("a33_per_intent", "select setup, detected, count(metric) as n, round(avg(metric), 6) as mean from v_scores group by setup, detected")
def a33(v):
    return _scores(v).groupBy("setup", "detected").agg(F.count("metric").alias("n"), F.round(F.avg("metric"), 6).alias("mean"))


@query("a17_band_report", f"""
with x as (select l_returnflag as field, cast(floor(l_extendedprice / 10) as bigint) as v from lineitem where l_extendedprice >= 10),
 r as (select field, v, row_number() over (partition by field order by v) as rn, count(*) over (partition by field) as n from x)
select field, max(n) as n, min(v) filter (rn * 100 >= n * 33) as p33, min(v) filter (rn * 100 >= n * 67) as p67, min(v) filter (rn * 100 >= n * 92) as p92,
 {R('count(*) filter (v < 500)', 'max(n)', 4)} as low, {R('count(*) filter (v >= 500 and v < 1500)', 'max(n)', 4)} as moderate,
 {R('count(*) filter (v >= 1500 and v < 5000)', 'max(n)', 4)} as high, {R('count(*) filter (v >= 5000)', 'max(n)', 4)} as very_high from r group by field""")
def a17(v):
    x = v.table("lineitem").withColumnRenamed("l_returnflag", "field")
    return E.band_report(x, ["field"], F.floor(F.col("l_extendedprice") / 10).cast("bigint"))


@query("s21_stack_setups", "select 'vector' as label, setup, count(*) as n from v_scores where setup = 'view' group by setup union all select 'graph', setup, count(*) from v_scores where setup = 'click' group by setup")
def s21(v):
    from placelore.session import union_all

    s = _scores(v)
    parts = [s.filter(F.col("setup") == k).withColumn("label", F.lit(name)) for name, k in (("vector", "view"), ("graph", "click"))]
    return union_all(parts).groupBy("label", "setup").agg(F.count("*").alias("n"))
