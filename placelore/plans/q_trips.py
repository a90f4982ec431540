"""Registered queries over trips, routes and requests. Requests are all open orders, past trips all completed ones."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from placelore.functions.geo import haversine_km, road_km
from placelore.operators import trips as P
from placelore.plans.registry import query
from placelore.session import pin

_H = "2 * 6371 * atan2(sqrt({h}), sqrt(1 - ({h})))"
_HAV = "pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2)"

# nearest-neighbour orders: one row per request and visited stop; k = 0 is the start
_NN = """
 stp as materialized (select * from v_stops), lg as materialized (select * from v_legs),
 nn as (select req_id, 0 as k, 0::bigint as cur, [0::bigint] as ord from stp where i = 0
   union all
   select req_id, k, j, list_append(ord, j) from (
     select nn.req_id, nn.k + 1 as k, l.j, nn.ord, row_number() over (partition by nn.req_id order by l.{w}, l.j) as rn
     from nn join lg l on l.req_id = nn.req_id and l.i = nn.cur where not list_contains(nn.ord, l.j)) where rn = 1),
 full_nn as (select nn.req_id, ord, n from nn join (select distinct req_id, n from stp) using (req_id) where len(ord) = n)"""

# metrics of routes(req_id, key..., ord): needs stp and lg
_METRICS = """(select {keys}, any_value(ord) as ord, cast(sum(dur) + sum(coalesce(t, 0)) as bigint) as total_time, cast(sum(coalesce(d, 0)) as bigint) as total_distance,
    sum(cost) as total_cost, round(sum(sat), 6) as total_satisfaction, count(*) as n_places
  from (select r.*, s.dur, s.cost, s.sat, l.t, l.d, r.p > 1 and l.t is null as broken
        from (select *, ord[p] as cur, case when p > 1 then ord[p - 1] end as prv from (select *, unnest(generate_series(1, len(ord))) as p from {src})) r
        join stp s on s.req_id = r.req_id and s.i = r.cur left join lg l on l.req_id = r.req_id and l.i = r.prv and l.j = r.cur)
  group by {keys} having not bool_or(broken))"""


@query("s4_matrix_to_edges", """
select a, b, round(distance_km, 6) as distance_km, round(travel_time_min, 6) as travel_time_min from (
 select nk.n_name as a, m.n_name as b, abs(nk.n_nationkey - m.n_nationkey) * 3e0 - 3 as distance_km, nk.n_nationkey + m.n_nationkey * 2e0 as travel_time_min
 from nation nk join nation m on nk.n_nationkey <> m.n_nationkey) where distance_km > 0""")
def s4(v):
    from pyspark.sql.types import DoubleType

    n = v.table("nation")
    # two wide matrices: one row per nation, one column per nation (25 nations, a fixed table)
    keys = range(25)
    dist = n.select(F.col("n_name").alias("place"), *[(F.abs(F.col("n_nationkey") - k) * 3.0 - 3).cast(DoubleType()).alias(f"NATION_{k}") for k in keys])
    dur = n.select(F.col("n_name").alias("place"), *[(F.col("n_nationkey") + k * 2.0).cast(DoubleType()).alias(f"NATION_{k}") for k in keys])
    e = P.wide_to_edges(dist, dur, "place")
    return e.select("a", "b", F.round("distance_km", 6).alias("distance_km"), F.round("travel_time_min", 6).alias("travel_time_min"))


@query("j15_two_way_edges", "select a, b, distance_km, travel_time_min from v_roads")
def j15(v):
    return v.roads.select("a", "b", "distance_km", "travel_time_min")


_PAIRS = """pairs as (select x.place_id as a, y.place_id as b, count(*) as n from v_trips x join v_trips y on x.trip_id = y.trip_id and y.pos = x.pos + 1 group by 1, 2),
 one_way as (select a, b from v_edges),
 hit as (select p.*, f.a is not null as fwd, r.a is not null as rev from pairs p left join one_way f on f.a = p.a and f.b = p.b left join one_way r on r.a = p.b and r.b = p.a)"""


@query("j16_past_trip_weights", f"""
with {_PAIRS} select e.a, e.b, 1 + 5e0 * coalesce(sum(n), 0) as pheromone from one_way e
left join (select case when fwd then a else b end as a, case when fwd then b else a end as b, n from hit where fwd or rev) u on u.a = e.a and u.b = e.b group by e.a, e.b""")
def j16(v):
    return P.past_trip_weights(v.trips, v.edges)[0].select("a", "b", "pheromone")


@query("j16_matched_missing", f"with {_PAIRS} select cast(coalesce(sum(n) filter (fwd or rev), 0) as bigint) as matched, cast(coalesce(sum(n) filter (not fwd and not rev), 0) as bigint) as missing from hit")
def j16b(v):
    return P.past_trip_weights(v.trips, v.edges)[1]


@query("s24_map_trip_names", """
with m as (select s_name as raw_name, s_nationkey as place_id from supplier where s_acctbal > 0),
 t as (select trip_id, pos, m.place_id, lag(m.place_id) over (partition by trip_id order by pos) as prv from v_trips v join supplier on v.place_id = s_suppkey join m on m.raw_name = s_name)
select trip_id, pos, cast(place_id as bigint) as place_id from t where prv is null or prv <> place_id""")
def s24(v):
    s = v.table("supplier")
    named = v.trips.join(s.select(F.col("s_suppkey").alias("place_id"), F.col("s_name").alias("raw_name")), "place_id").drop("place_id")
    mapping = s.filter("s_acctbal > 0").select(F.col("s_name").alias("raw_name"), F.col("s_nationkey").alias("place_id"))
    return P.map_names(named, mapping).select("trip_id", "pos", F.col("place_id").cast("bigint").alias("place_id"))


@query("m17_m18_road_or_straight", """
select a, b, case when e.distance_km is not null then floor(e.distance_km * 10 + 0.5) / 10 else floor(1.2 * km * 10 + 0.5) / 10 end as km from (
  select x.place_id as a, y.place_id as b, """ + _H.format(h=_HAV.format(a="pa.", b="pb.")) + """ as km from v_trips x join v_trips y on x.trip_id = y.trip_id and y.pos = x.pos + 2
  join v_places pa on pa.place_id = x.place_id join v_places pb on pb.place_id = y.place_id group by all) left join v_edges e using (a, b)""")
def m18(v):
    w = W.partitionBy("trip_id").orderBy("pos")
    pairs = v.trips.select(F.col("place_id").alias("a"), F.lead("place_id", 2).over(w).alias("b")).filter("b is not null").distinct()
    at = lambda k: v.places.select(F.col("place_id").alias(k), F.col("lat").alias(f"lat_{k}"), F.col("lon").alias(f"lon_{k}"))
    j = pairs.join(at("a"), "a").join(at("b"), "b").join(v.edges.select("a", "b", "distance_km"), ["a", "b"], "left")
    return j.select("a", "b", road_km(F.col("distance_km"), haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))).alias("km"))


@query("a35_w3_route_metrics", f"""
with {_NN.replace('nn as (', 'unused as (select 1), r0 as (select req_id, list(i order by i) as ord from stp group by req_id), nn0 as (', 1).split('nn0 as (')[0].rstrip().rstrip(',')},
 m as {_METRICS.format(keys='req_id', src='r0')}
select req_id, total_time / 1e6 as total_time_min, total_distance / 1e6 as total_distance_km, total_cost, total_satisfaction, n_places from m""")
def a35(v):
    m = P.route_metrics(v.requests.withColumn("ord", F.sequence(F.lit(0), F.col("n") - 1)))
    return m.select("req_id", (F.col("total_time") / P.MICRO).alias("total_time_min"), (F.col("total_distance") / P.MICRO).alias("total_distance_km"),
                    "total_cost", "total_satisfaction", F.col("n_places").cast("bigint").alias("n_places"))


@query("w3_route_legs", """
select s.req_id, s.i + 1 as leg_no, s.place_id, s.dur / 1e6 as visit_min, coalesce(l.t, 0) / 1e6 as travel_min, coalesce(l.d, 0) / 1e6 as distance_km
from v_stops s left join v_legs l on l.req_id = s.req_id and l.j = s.i and l.i = s.i - 1 where s.i = 0 or l.t is not null""")
def w3(v):
    rows = P.legs_table(v.requests.withColumn("ord", F.sequence(F.lit(0), F.col("n") - 1)), ["req_id"])
    return rows.filter("travel is not null").select("req_id", F.col("leg_no").cast("bigint").alias("leg_no"), "place_id", (F.col("visit") / P.MICRO).alias("visit_min"),
                                                    (F.col("travel") / P.MICRO).alias("travel_min"), (F.col("distance") / P.MICRO).alias("distance_km"))


@query("f13_valid_routes", """
with ok as (select s.req_id, bool_and(s.i = 0 or l.t is not null) as connected, cast(sum(s.dur + coalesce(l.t, 0)) as bigint) as t
  from v_stops s left join v_legs l on l.req_id = s.req_id and l.j = s.i and l.i = s.i - 1 group by s.req_id)
select req_id, t <= budget as within_budget from ok join v_budget using (req_id) where connected""")
def f13(v):
    m = P.route_metrics(v.requests.withColumn("ord", F.sequence(F.lit(0), F.col("n") - 1)))
    return m.select("req_id", (F.col("total_time") <= F.col("budget")).alias("within_budget"))


@query("p1_nearest_neighbour", f"""
with recursive {_NN.format(w='t')} select req_id, array_to_string(ord, '>') as route from full_nn""")
def p1(v):
    r = pin(v.requests, ord=P.nearest_order(P._upto(F.col("n"))))
    return P.route_metrics(r).select("req_id", F.array_join(F.transform("ord", lambda x: x.cast("string")), ">").alias("route"))


@query("p2_best_order", f"""
with recursive {_NN.format(w='t')},
 g as (select req_id, n, 1 as k, 0::bigint as cur, [0::bigint] as ord, dur as t from stp where i = 0 and n <= 9
   union all select g.req_id, g.n, g.k + 1, l.j, list_append(g.ord, l.j), g.t + l.t + s.dur from g join lg l on l.req_id = g.req_id and l.i = g.cur
     join stp s on s.req_id = g.req_id and s.i = l.j join v_budget b on b.req_id = g.req_id
     where not list_contains(g.ord, l.j) and g.t + l.t + s.dur <= b.budget),
 f as (select * from g where k = n and (n > 1 or t <= (select budget from v_budget b where b.req_id = g.req_id))),
 m as {_METRICS.format(keys='req_id', src="(select req_id, ord from full_nn where n > 9)")}
select req_id, 'exact' as method, count(*) as n_feasible, min(t) / 1e6 as total_time_min, arg_min(array_to_string(ord, '>'), (t, array_to_string(ord, '>'))) as route from f group by req_id
union all select req_id, 'greedy', null, total_time / 1e6, array_to_string(ord, '>') from m""")
def p2(v):
    b = P.best_orders(v.requests.filter("n > 1 or dur[0] <= budget"), budget="budget")
    return b.select("req_id", "method", "n_feasible", (F.col("total_time") / P.MICRO).alias("total_time_min"), F.array_join(F.transform("ord", lambda x: x.cast("string")), ">").alias("route"))


_SCORE = """0.75e0 * (0.25e0 * {s} + 0.15e0 * {c} + 0.25e0 * {t} + 0.15e0 * {h} + 0.10e0 * {d}) + 0.25e0 * {p}"""


def _mm(col, up, part):
    lo, hi = f"min({col}) over (partition by {part})", f"max({col}) over (partition by {part})"
    x = f"greatest(0e0, least(1e0, ({col} - {lo}) / ({hi} - {lo})))"
    return f"case when {lo} = {hi} then 1e0 else {x if up else '1e0 - ' + x} end"


def _score_sql(part, sim="similarity"):
    return _SCORE.format(s=_mm("total_satisfaction", True, part), c=_mm("total_cost", False, part), t=_mm("total_time", False, part),
                         h=_mm(sim, True, part), d=_mm("total_distance", False, part), p=_mm("n_places", True, part))


# orders grow stop by stop; visited stops are bits and the order is a number, so that rows stay small
@query("w6_rank_among_orders", f"""
with recursive {_NN.format(w='t')},
 g as (select req_id, n, 1 as k, 0::bigint as cur, 1::bigint as seen, 0::bigint as code, 0::bigint as total_time, 0::bigint as total_distance from stp where i = 0 and n <= 9
   union all select g.req_id, g.n, g.k + 1, l.j, g.seen | (1::bigint << l.j), g.code * 10 + l.j, g.total_time + l.t, g.total_distance + l.d from g join lg l on l.req_id = g.req_id and l.i = g.cur where g.seen & (1::bigint << l.j) = 0),
 f as materialized (select req_id, total_time, total_distance, code from g where k = n),
 b as (select req_id, min(total_time) as lt, max(total_time) as ht, min(total_distance) as ld, max(total_distance) as hd from f group by req_id),
 sc as (select req_id, code, round(0.75e0 * (0.55e0 + 0.25e0 * case when lt = ht then 1e0 else 1e0 - (total_time - lt) / (ht - lt) end + 0.10e0 * case when ld = hd then 1e0 else 1e0 - (total_distance - ld) / (hd - ld) end) + 0.25e0, 9) as score
   from f join b using (req_id)),
 mine as (select sc.req_id, sc.score from sc join (select req_id, list_reduce(ord, lambda a, x: a * 10 + x) as code from full_nn where n <= 9) using (req_id, code))
select sc.req_id, 'exact' as method, count(*) as n_orders, 1 + count(*) filter (sc.score > mine.score) as rank, max(sc.score) = any_value(mine.score) as top1,
  round(greatest(0, (max(sc.score) - any_value(mine.score)) / max(sc.score)) * 100, 4) as gap_pct from sc join mine on sc.req_id = mine.req_id group by sc.req_id
union all select m.req_id, 'greedy', null, null, null, null from {_METRICS.format(keys='req_id', src="(select req_id, ord from full_nn where n > 9)")} m""")
def w6(v):
    req = pin(v.requests, nn=P.nearest_order(P._upto(F.col("n"))))
    short = req.filter("n <= 9").withColumn("nn_code", F.aggregate(F.slice("nn", 2, 8), F.lit(0).cast("bigint"), lambda a, x: a * 9 + x))
    orders = P.all_orders(short, carry=["nn_code"])
    w = W.partitionBy("req_id")
    s = lambda c: P.scaled(F.col(c), F.min(c).over(w), F.max(c).over(w), False)
    scored = orders.select("req_id", "code", "nn_code", F.round(0.75 * (0.55 + 0.25 * s("t") + 0.10 * s("d")) + 0.25, 9).alias("score"))
    scored = scored.withColumn("mine", F.max(F.when(F.col("code") == F.col("nn_code"), F.col("score"))).over(w)).filter("mine is not null")
    exact = scored.groupBy("req_id").agg(F.count("*").alias("n_orders"), (1 + F.count_if(F.col("score") > F.col("mine"))).alias("rank"),
                                         (F.max("score") == F.max("mine")).alias("top1"),
                                         F.round(F.greatest(F.lit(0.0), (F.max("score") - F.max("mine")) / F.max("score")) * 100, 4).alias("gap_pct"))
    # over nine places (40,320 orders) the greedy route itself is the answer; it is not ranked among orders that were not made
    greedy = req.filter(F.col("n") > 9).filter(P.total_time(F.col("nn")).isNotNull()).select("req_id", F.lit("greedy").alias("method"))
    return exact.withColumn("method", F.lit("exact")).unionByName(greedy, allowMissingColumns=True)


@query("w6_rank_any_length")
def w6_any(v):
    """Requests of every length, by subset programming and halves of orders; SQL would have to list 12! orders."""
    req = pin(v.requests, nn=P.nearest_order(P._upto(F.col("n"))))
    return P.rank_orders(req, "nn")


@query("m20_history_similarity", """
with t as (select trip_id, list(distinct place_id order by place_id) as s from v_trips group by trip_id), r as (select req_id, list(distinct place_id order by place_id) as s from v_req_stops group by req_id),
 ti as (select trip_id, len(s) as n, unnest(s) as p from (select distinct on (s) trip_id, s from t)), ri as (select s, len(s) as n, unnest(s) as p from (select distinct s from r)),
 j as (select ri.s, count(*) / (any_value(ri.n) + any_value(ti.n) - count(*)) as j from ri join ti using (p) group by ri.s, trip_id)
select req_id, round(coalesce(m, 0), 6) as similarity from r left join (select s, max(j) as m from j group by s) using (s)""")
def m20(v):
    sets = v.req_stops.groupBy("req_id").agg(F.array_sort(F.collect_set("place_id")).alias("set"))
    sim = P.history_similarity(sets.select("set").distinct(), *P.history_index(v.trips))
    return sets.join(sim, "set").select("req_id", F.round("similarity", 6).alias("similarity"))


@query("w4_day_split", """
with recursive stp as materialized (select s.*, coalesce(l.t, 0) as t, coalesce(l.d, 0) as d from v_stops s left join v_legs l on l.req_id = s.req_id and l.j = s.i and l.i = s.i - 1),
 f as (select req_id, i, 1 as day, dur as tm, 0::bigint as dist from stp where i = 0
  union all select f.req_id, s.i, case when f.tm + s.dur + s.t > 480000000 and f.day < 3 then f.day + 1 else f.day end,
    case when f.tm + s.dur + s.t > 480000000 and f.day < 3 then s.dur + s.t else f.tm + s.dur + s.t end,
    case when f.tm + s.dur + s.t > 480000000 and f.day < 3 then s.d else f.dist + s.d end from f join stp s on s.req_id = f.req_id and s.i = f.i + 1)
select f.req_id, day, string_agg(cast(place_id as varchar), '>' order by f.i) as places, max_by(tm, f.i) / 1e6 as time_min, max_by(dist, f.i) / 1e6 as distance_km, max_by(tm, f.i) <= 480000000 as within_limit
from f join stp on stp.req_id = f.req_id and stp.i = f.i group by f.req_id, day""")
def w4(v):
    order = F.sequence(F.lit(0), F.col("n") - 1)
    d = v.requests.select("req_id", F.explode(P.day_split(order, F.lit(3), F.lit(8))).alias("x"))
    return d.select("req_id", "x.day", F.array_join(F.transform("x.places", lambda p: p.cast("string")), ">").alias("places"),
                    (F.col("x.time") / P.MICRO).alias("time_min"), (F.col("x.distance") / P.MICRO).alias("distance_km"), F.col("x.within").alias("within_limit"))


# candidate pool over the nearest-neighbour route only: the route, its reversals of 2..4 stops, its prefixes
_POOL = f"""{_NN.format(w='t')},
 cut as (select req_id, ord, n, unnest(generate_series(1, n - 2)) as i from full_nn where n >= 3),
 cut2 as (select *, unnest([2, 3, 4]) as len from cut),
 rev as (select req_id, list_concat(list_concat(ord[1:i], list_reverse(ord[i + 1:i + len])), ord[i + len + 1:]) as ord from cut2 where i < n - len or (len = 2 and i < n - 1)),
 pre as (select req_id, ord[1:k] as ord from (select req_id, ord, unnest(generate_series(2, n)) as k from full_nn where n > 1)),
 pool as (select distinct req_id, ord from (select req_id, ord from full_nn union all select * from rev union all select * from pre)),
 met as (select req_id, total_time, total_distance, total_cost, total_satisfaction, n_places, ord from {_METRICS.format(keys='req_id, array_to_string(ord, chr(44))', src='pool').replace('array_to_string(ord, chr(44)), any_value', 'any_value', 1)} q),
 tset as (select distinct s, len(s) as n from (select trip_id, list(distinct place_id order by place_id) as s from v_trips group by trip_id)),
 ti as (select s as ts, n, unnest(s) as p from tset),
 rset as (select req_id, ord, list_sort(list_transform(ord, lambda x: m[x])) as s from met join (select req_id, map_from_entries(list((i, place_id))) as m from stp group by req_id) using (req_id)),
 ri as (select s, unnest(s) as p from (select distinct s from rset)),
 sim as (select s, max(j) as j from (select s, c / (len(s) + n - c) as j from (select ri.s, ts, any_value(n) as n, count(*) as c from ri join ti using (p) group by ri.s, ts)) group by s),
 pts as (select met.*, coalesce(j, 0) as similarity, array_to_string(list_transform(ord, lambda x: lpad(cast(x as varchar), 2, '0')), '>') as route_key
   from met join rset using (req_id, ord) left join sim using (s))"""


def _nn_pool(v):
    """The pool without the improved route, which SQL does not express, as an array in the request's row."""
    return P.route_pool(v.requests, v.trips)


@query("p4_route_variants", f"""
with recursive {_POOL} select req_id, route_key, total_time / 1e6 as total_time_min, total_distance / 1e6 as total_distance_km, total_cost, total_satisfaction, round(similarity, 6) as similarity from pts""")
def p4(v):
    return _nn_pool(v).select("req_id", F.inline("routes")).select("req_id", "route_key", (F.col("total_time") / P.MICRO).alias("total_time_min"), (F.col("total_distance") / P.MICRO).alias("total_distance_km"),
                              "total_cost", "total_satisfaction", F.round("similarity", 6).alias("similarity"))


_DOM = "b.total_satisfaction >= a.total_satisfaction and b.total_cost <= a.total_cost and b.total_time <= a.total_time and b.similarity >= a.similarity and (b.total_satisfaction > a.total_satisfaction or b.total_cost < a.total_cost or b.total_time < a.total_time or b.similarity > a.similarity)"


@query("p8_pareto_front", f"""
with recursive {_POOL}, mpts as materialized (select * from pts)
select req_id, route_key from mpts a where not exists (select 1 from mpts b where a.req_id = b.req_id and {_DOM})""")
def p8(v):
    return _nn_pool(v).select("req_id", F.inline(P.pool_front("routes"))).select("req_id", "route_key")


@query("w9_m21_preference_scores", f"""
with recursive {_POOL} select req_id, route_key, round({_score_sql('req_id')}, 6) as score from pts""")
def w9(v):
    return P.pool_scores(_nn_pool(v), "routes").select("req_id", F.inline("routes")).select("req_id", "route_key", F.round("preference_score", 6).alias("score"))


@query("k9_rank_pareto_first", f"""
with recursive {_POOL}, mpts as materialized (select * from pts),
 fr as (select * from mpts a where not exists (select 1 from mpts b where a.req_id = b.req_id and {_DOM})),
 u as (select req_id, route_key, 1 as in_front, round({_score_sql('req_id')}, 9) as sc from fr
   union all select * from (select req_id, route_key, 0, round({_score_sql('req_id')}, 9) from mpts) q where (req_id, route_key) not in (select (req_id, route_key) from fr)),
 rk as (select *, row_number() over (partition by req_id order by in_front desc, sc desc, route_key) as rank from u)
select req_id, route_key, in_front, rank from rk where in_front = 1 or rank <= 4""")
def k9(v):
    return P.rank_pool(_nn_pool(v)).select("req_id", "route_key", "in_front", F.col("rank").cast("bigint").alias("rank"))


@query("a38_front_indicators", f"""
with recursive {_POOL}, mpts as materialized (select * from pts),
 fr as (select * from mpts a where not exists (select 1 from mpts b where a.req_id = b.req_id and {_DOM})),
 n as (select 'a' as side, req_id, {_mm('total_satisfaction', True, 'req_id')} as x, {_mm('total_cost', False, 'req_id')} as y, {_mm('similarity', True, 'req_id')} as z from mpts
   union all select 'r', req_id, {_mm('total_satisfaction', True, 'req_id')}, {_mm('total_cost', False, 'req_id')}, {_mm('similarity', True, 'req_id')} from fr),
 pr as (select p.req_id, p.side, p.x, p.y, p.z, min(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2))) as dmin from (select *, row_number() over () as id from n) p join n q on p.req_id = q.req_id and p.side <> q.side group by p.id, p.req_id, p.side, p.x, p.y, p.z)
select req_id, round(sqrt(avg(dmin * dmin) filter (side = 'a')), 6) as gd, round(avg(dmin) filter (side = 'r'), 6) as igd,
  round(sqrt(pow(max(x) filter (side = 'a') - min(x) filter (side = 'a'), 2) + pow(max(y) filter (side = 'a') - min(y) filter (side = 'a'), 2) + pow(max(z) filter (side = 'a') - min(z) filter (side = 'a'), 2)), 6) as ms
from pr group by req_id""")
def a38(v):
    pools = pin(_nn_pool(v), front=P.pool_front("routes"))
    return P.pool_indicators(pools, "routes", "front").select("req_id", *[F.round(c, 6).alias(c) for c in ("gd", "igd", "ms")])


@query("m22_m25_detailed_scores", f"""
with recursive {_POOL.replace('pool as (select distinct', 'pool as (select distinct', 1)},
 st as (select p.*, (select avg(dur) / 1e6 from stp where stp.req_id = p.req_id and list_contains(p.ord, stp.i)) as stay from pts p),
 x as (select *, n_places as n, greatest(total_time / 1e6, 1e0) as t, greatest(total_distance / 1e6, 1e0) as d, n_places * 90 + (n_places - 1) * 40 as it, (n_places - 1) * 40 as idd from st)
select req_id, route_key, round(least(1, total_satisfaction / (n * 3.5e0)), 6) as s_satisfaction, round(greatest(0, 1 - abs(t - it) / greatest(t, it)), 6) as s_time,
 round(greatest(0, 1 - abs(d - idd) / greatest(d, idd, 1)), 6) as s_distance, round(1 / (1 + total_cost / 5000), 6) as s_budget, round(1 - least(1, abs(stay - 120) / 180), 6) as s_stay,
 round(0.25e0 * least(1, total_satisfaction / (n * 3.5e0)) + 0.15e0 * (1 / (1 + total_cost / 5000)) + 0.25e0 * greatest(0, 1 - abs(t - it) / greatest(t, it)) + 0.15e0 * similarity
  + 0.10e0 * greatest(0, 1 - abs(d - idd) / greatest(d, idd, 1)) + 0.05e0 + 0.05e0 * (1 - least(1, abs(stay - 120) / 180)), 6) as overall from x""")
def m22(v):
    c = _nn_pool(v).select("req_id", F.inline("routes")).withColumns({"bad_places": F.lit(0), "checked_places": F.lit(0)})
    d = P.detailed_scores(c)
    return d.select("req_id", "route_key", *[F.round(k, 6).alias(k) for k in ("s_satisfaction", "s_time", "s_distance", "s_budget", "s_stay", "overall")])


@query("p3_budget_subsets")
def p3(v):
    o = P.subset_options(v.requests)
    return o.select("req_id", "opt", "label", F.array_join(F.transform("chosen", lambda x: x.cast("string")), ">").alias("chosen"),
                    (F.col("time") / P.MICRO).alias("time_min"), "satisfaction", "fitted_all")


@query("p5_two_opt")
def p5(v):
    r = pin(pin(v.requests, nn=P.nearest_order(P._upto(F.col("n")))), opt=P.two_opt(F.col("nn")))
    return r.select("req_id", F.array_join(F.transform("opt", lambda x: x.cast("string")), ">").alias("route"),
                    (P.path_sum(F.col("nn"), "tm") / P.MICRO).alias("before_min"), (P.path_sum(F.col("opt"), "tm") / P.MICRO).alias("after_min"))


@query("p6_sampled_walks")
def p6(v):
    w = P.sampled_walks(v.requests)
    return w.select("req_id", "iteration", "walker", F.array_join(F.transform("ord", lambda x: x.cast("string")), ">").alias("route"),
                    (F.col("total_time") / P.MICRO).alias("time_min"), F.round("total_satisfaction", 6).alias("satisfaction"))


@query("p7_shortest_paths", """
with recursive e as materialized (select a, b, cast(round(travel_time_min * 1000000) as bigint) as w from v_roads),
""" + ",\n".join(["r0 as materialized (select place_id as source, place_id as node, 0::bigint as total from v_places)"] + [
    f"r{k} as materialized (select source, node, min(total) as total from (select * from r{k - 1} union all select source, e.b, total + w from r{k - 1} join e on e.a = node) group by source, node)" for k in range(1, 11)]) + """,
p as materialized (select x.source, e.b as node, min(e.a) as prev from r10 x join e on e.a = x.node join r10 y on y.source = x.source and y.node = e.b where x.total + w = y.total and e.b <> x.source group by all),
t as (select source, source as node, cast(source as varchar) as path from r10 where source = node union all select p.source, p.node, path || '>' || p.node from t join p on p.source = t.source and p.prev = t.node)
select source, node, total / 1e6 as total_min, path from r10 join t using (source, node)""")
def p7(v):
    ways = P.shortest_paths(v.places.select(F.col("place_id").alias("source")), v.roads)
    r = P.shortest_routes(ways)
    return r.select("source", "node", F.col("total").alias("total_min"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("p10_baselines")
def p10(v):
    r = v.requests
    nn_t, nn_d = P.nearest_order(P._upto(F.col("n")), "tm"), P.nearest_order(P._upto(F.col("n")), "dm")
    base = pin(pin(r, a=nn_t, b=nn_d), c=P.two_opt(F.col("a"), "tm"), d=P.two_opt(F.col("b"), "dm"))
    named = F.array(*[F.struct(F.lit(name).alias("baseline"), F.col(c).alias("ord")) for name, c in
                      (("NearestNeighbour-Time", "a"), ("NearestNeighbour-Distance", "b"), ("NN-Time+2opt", "c"), ("NN-Distance+2opt", "d"))])
    m = P.route_metrics(base.select("*", F.inline(named))).filter("total_time <= budget")
    return m.select("req_id", "baseline", F.array_join(F.transform("ord", lambda x: x.cast("string")), ">").alias("route"), (F.col("total_time") / P.MICRO).alias("time_min"))


@query("w7_best_per_baseline", """
with x as (select o_custkey % 97 as grp, o_orderpriority as name, o_orderkey, o_totalprice as score from orders)
select grp, name, max(score) as score, max_by(o_orderkey, score) as o_orderkey from x group by grp, name""")
def w7(v):
    x = v.table("orders").select((F.col("o_custkey") % 97).alias("grp"), F.col("o_orderpriority").alias("name"), "o_orderkey", F.col("o_totalprice").alias("score"))
    return x.groupBy("grp", "name").agg(F.max("score").alias("score"), F.max_by("o_orderkey", "score").alias("o_orderkey"))


@query("p11_full_plan")
def p11(v):
    p = P.plan(v.requests, v.trips)
    day = F.transform("day_plan", lambda d: F.array_join(F.transform(d["places"], lambda x: x.cast("string")), ">"))
    return p.select("req_id", F.col("rank").cast("bigint").alias("rank"), "route_key", "in_front", F.round("preference_score", 6).alias("score"),
                    (F.col("total_time") / P.MICRO).alias("time_min"), F.array_join(day, " | ").alias("days"), "reason")


@query("p9_method_report")
def p9(v):
    """Planned routes, baselines and the true best order per request, and the gain over the best baseline."""
    from placelore.session import durable

    req = v.requests
    best = P.best_orders(req, budget="budget").select("req_id", F.when(F.col("method") == "exact", "true best").otherwise("greedy best").alias("method"), F.col("total_time").alias("t"))
    nn = pin(req, a=P.nearest_order(P._upto(F.col("n"))))
    nn = pin(nn, b=P.two_opt(F.col("a")))
    base = nn.select("req_id", "budget", F.inline(F.array(F.struct(F.lit("nearest").alias("method"), P.total_time(F.col("a")).alias("t")),
                                                          F.struct(F.lit("nearest + 2-opt").alias("method"), P.total_time(F.col("b")).alias("t")))))
    rows = durable(best.unionByName(base.filter("t <= budget").select("req_id", "method", "t")))
    low = rows.filter("method not in ('true best', 'greedy best')").groupBy("req_id").agg(F.min("t").alias("baseline"))
    return rows.join(low, "req_id", "left").select("req_id", "method", (F.col("t") / P.MICRO).alias("time_min"),
                                                  F.round((F.col("baseline") - F.col("t")) / F.col("baseline") * 100, 4).alias("gain_pct"))
