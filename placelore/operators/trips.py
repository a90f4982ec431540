"""Trip planning over tables of requests.

A request is one row: its stops as arrays (index 0 is the start) and the leg times and distances among them as flat
n x n arrays. Building that row is the only shuffle; ordering, packing, variants, day splits and scores are then
expressions on the row. Times and distances are whole micro-units, so sums do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from placelore.functions.text import fill
from placelore.session import pin

MICRO = 1_000_000
NO_EDGE = 10 ** 15  # stands for a missing leg where a number is needed
LISTED = 1 << 17  # so many orders are summed at once
WEIGHTS = {"attraction": 0.25, "budget": 0.15, "time": 0.25, "popular": 0.15}


# -- edges ------------------------------------------------------------------------------------------------

def wide_to_edges(distance: DataFrame, duration: DataFrame, name: str) -> DataFrame:
    """Two wide matrices to long edges: no self loops, positive distance, pair present in both."""
    def long(df, value):
        cols = [c for c in df.columns if c != name]
        return df.unpivot(name, cols, "b", value).withColumnRenamed(name, "a")

    return (long(distance, "distance_km").join(long(duration, "travel_time_min"), ["a", "b"])
            .filter("a <> b and distance_km > 0 and travel_time_min is not null"))


def two_way(edges: DataFrame) -> DataFrame:
    """Forward edges, and reversed ones where no forward edge exists."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *[c for c in edges.columns if c not in ("a", "b")])
    return edges.unionByName(back.join(edges.select("a", "b"), ["a", "b"], "left_anti").select(*edges.columns))


def roads_from(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """What ``two_way`` gives for the roads that begin at one of ``starts`` (a), made of their own edges only."""
    out = edges.join(starts, "a", "left_semi")
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *[c for c in edges.columns if c not in ("a", "b")]).join(starts, "a", "left_semi")
    return out.unionByName(back.join(out.select("a", "b"), ["a", "b"], "left_anti").select(*edges.columns))


def past_trip_weights(trips: DataFrame, edges: DataFrame, boost: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """Edge weights raised by past trips (forward edge first, else its reverse), and matched/missing counts.

    Consecutive pairs are counted before the join, so a popular leg is one row.
    """
    w = W.partitionBy("trip_id").orderBy("pos")
    pairs = (trips.select(F.col("place_id").alias("a"), F.lead("place_id").over(w).alias("b")).filter("b is not null")
             .groupBy("a", "b").agg(F.count("*").alias("n")))
    known = edges.select("a", "b", F.lit(True).alias("fwd"))
    reverse = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("rev"))
    hit = pairs.join(known, ["a", "b"], "left").join(reverse, ["a", "b"], "left")
    used = (hit.filter("fwd or rev").select(F.when(F.col("fwd"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                            F.when(F.col("fwd"), F.col("b")).otherwise(F.col("a")).alias("b"), "n")
            .groupBy("a", "b").agg(F.sum("n").alias("n")))
    weights = edges.join(used, ["a", "b"], "left").withColumn("pheromone", 1.0 + boost * F.coalesce("n", F.lit(0)))
    report = hit.agg(F.coalesce(F.sum(F.when(F.col("fwd") | F.col("rev"), F.col("n"))), F.lit(0)).alias("matched"),
                     F.coalesce(F.sum(F.when(F.col("fwd").isNull() & F.col("rev").isNull(), F.col("n"))), F.lit(0)).alias("missing"))
    return weights, report


def map_names(trips: DataFrame, mapping: DataFrame) -> DataFrame:
    """Raw names to listed names; unmapped visits are dropped, consecutive repeats of a place collapse."""
    named = trips.join(mapping, "raw_name")
    w = W.partitionBy("trip_id").orderBy("pos")
    return (named.withColumn("_prev", F.lag("place_id").over(w))
            .filter(F.col("_prev").isNull() | (F.col("_prev") != F.col("place_id"))).drop("_prev"))


def route_arrays(stops: DataFrame, key: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("pos", "place_id")))
    return stops.groupBy(key).agg(ordered.alias("_s")).select(key, F.transform("_s", lambda s: s["place_id"]).alias("route"))


def shortest_paths(sources: DataFrame, roads: DataFrame, weight: str = "travel_time_min", max_rounds: int = 100) -> DataFrame:
    """Least total weight from each source to every reachable node: (source, node, total, prev).

    ``prev`` is the node before on the way, null at the source; of equally short ways the smallest one. Total and prev
    are one comparable struct, so a round is a join and a minimum; only nodes with a smaller total move on, while an
    equal total can still bring a smaller prev. Each round is checkpointed; it ends when nothing improves.
    """
    from placelore.session import durable

    steps = durable(roads.filter(F.col(weight) > 0).select("a", "b", F.round(F.col(weight) * MICRO).cast("bigint").alias("w")))
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(None).cast(roads.schema["a"].dataType).alias("prev"))
    best = durable(sources.select("source", F.col("source").alias("node"), start.alias("way")).distinct())
    front = best
    for _ in range(max_rounds):
        tried = (front.join(steps, front.node == steps.a)
                 .select("source", F.col("b").alias("node"), F.struct((F.col("way.total") + F.col("w")).alias("total"), F.col("a").alias("prev")).alias("way"))
                 .groupBy("source", "node").agg(F.min("way").alias("new")))
        merged = durable(tried.join(best, ["source", "node"], "full").select(
            "source", "node", F.least("way", "new").alias("way"), (F.col("way").isNull() | (F.col("new.total") < F.col("way.total"))).alias("better")))
        best, front = merged.drop("better"), merged.filter("better").drop("better")
        if front.isEmpty():
            return best.select("source", "node", (F.col("way.total") / MICRO).alias("total"), "way.prev")
    raise RuntimeError("shortest paths did not settle")


def shortest_routes(ways: DataFrame) -> DataFrame:
    """``shortest_paths`` with the stops of each way: (source, node, total, path), the source first.

    Pointer jumps: a piece of a way and the node before it are joined to the piece that ends there, so pieces double and
    a way of n stops takes log2(n) joins. A path is as long as its way, so its array is bounded by the graph's diameter.
    """
    from placelore.session import durable

    pieces = ways.select("source", "node", "total", F.array("node").alias("path"), F.col("prev").alias("before"))
    while True:
        ends = pieces.select("source", F.col("node").alias("before"), F.col("path").alias("head"), F.col("before").alias("further"))
        pieces = durable(pieces.join(ends, ["source", "before"], "left").select(
            "source", "node", "total", F.when(F.col("head").isNull(), F.col("path")).otherwise(F.concat("head", "path")).alias("path"), F.col("further").alias("before")))
        if pieces.filter("before is not null").isEmpty():
            return pieces.drop("before")


# -- one row per request ------------------------------------------------------------------------------------

def unknown_starts(stops: DataFrame, places: DataFrame) -> DataFrame:
    """(req_id, reason) of requests whose first stop is no listed place; ``requests`` leaves them out."""
    first = stops.groupBy("req_id").agg(F.min_by("place_id", "pos").alias("place_id"))
    return first.join(places.select("place_id"), "place_id", "left_anti").select("req_id", F.lit("unknown start").alias("reason"))


def requests(stops: DataFrame, places: DataFrame, roads: DataFrame, keep: list[str] = ()) -> DataFrame:
    """(req_id, n, stops, dur, cost, sat, tm, dm, *keep) from (req_id, place_id, pos, *keep).

    Stops that are no listed place are left out; a request that would lose its start is not made, see unknown_starts.
    """
    facts = places.select("place_id", "duration_min", "cost", "satisfaction", F.lit(True).alias("known"))
    item = F.struct("pos", "place_id", "duration_min", "cost", "satisfaction", "known")
    rows = (stops.join(facts, "place_id", "left").groupBy("req_id", *keep).agg(F.array_sort(F.collect_list(item)).alias("s"))
            .filter(F.get("s", F.lit(0))["known"]).withColumn("s", F.filter("s", lambda x: x["known"]))
            .select("req_id", *keep, F.size("s").alias("n"), F.transform("s", lambda x: x["place_id"]).alias("stops"),
                    F.transform("s", lambda x: (x["duration_min"] * MICRO).cast("bigint")).alias("dur"),
                    F.transform("s", lambda x: x["cost"]).alias("cost"), F.transform("s", lambda x: x["satisfaction"]).alias("sat")))
    micro = lambda c: F.round(F.col(c) * MICRO).cast("bigint")
    legs = (rows.select("req_id", "stops", "n", F.posexplode("stops").alias("i", "a"))
            .select("req_id", "n", "i", "a", F.posexplode("stops").alias("j", "b")).filter("i <> j")
            .select("req_id", (F.col("i") * F.col("n") + F.col("j")).alias("k"), "a", "b")
            .join(roads.select("a", "b", micro("travel_time_min").alias("t"), micro("distance_km").alias("d")), ["a", "b"])
            .groupBy("req_id").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("t", "d")))).alias("m")))
    cells = F.sequence(F.lit(0), F.col("n") * F.col("n") - 1)
    at = lambda f: F.transform(cells, lambda k: F.try_element_at("m", k)[f])
    out = rows.join(legs, "req_id", "left").withColumns({"tm": at("t"), "dm": at("d")}).drop("m")
    # few bytes but much work per row: keep adaptive execution from folding the rows into a handful of tasks
    spark = out.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return out.repartition(tasks, "req_id")


def _upto(n: Column) -> Column:
    """[1 .. n-1], empty for n = 1."""
    return F.slice(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.lit(1), F.greatest(n - 1, F.lit(0)))


def leg(matrix: str, i: Column, j: Column) -> Column:
    return F.get(F.col(matrix), i * F.col("n") + j)


def path_sum(order: Column, matrix: str) -> Column:
    """Sum over consecutive legs; null when a leg is missing."""
    hops = _upto(F.size(order))
    return F.aggregate(hops, F.lit(0).cast("bigint"), lambda acc, k: acc + leg(matrix, F.get(order, k - 1), F.get(order, k)))


def pick_sum(order: Column, values: str) -> Column:
    zero = F.lit(0).cast("bigint") if values == "dur" else F.lit(0.0)
    return F.aggregate(order, zero, lambda acc, i: acc + F.get(F.col(values), i))


def total_time(order: Column) -> Column:
    return path_sum(order, "tm") + pick_sum(order, "dur")


def nearest_order(rem: Column, matrix: str = "tm") -> Column:
    """Start at stop 0, always go on to the nearest remaining stop (smaller index on ties). When none is connected
    the rest is appended as it is, and the route will have no metrics."""
    def step(route, _):
        cur = F.element_at(route, -1)
        left = F.array_except(rem, route)
        near = F.array_min(F.transform(left, lambda x: F.struct(F.coalesce(leg(matrix, cur, x), F.lit(NO_EDGE)).alias("w"), x.alias("x"))))
        return F.concat(route, F.coalesce(F.array(near["x"]), left))

    # a stop without an edge costs NO_EDGE, so it is taken last; such a route has no metrics
    return F.aggregate(rem, F.array(F.lit(0)), step)


def route_key(order: Column) -> Column:
    """The stops' numbers, two digits at least, in order."""
    return F.array_join(F.transform(order, lambda x: F.format_string("%02d", x)), ">")


def two_opt(order: Column, matrix: str = "tm", max_passes: int = 20) -> Column:
    """First improving segment reversal per pass, start fixed, until none improves."""
    n = F.size(order)

    def cost(r):
        return F.aggregate(_upto(F.size(r)), F.lit(0).cast("bigint"),
                           lambda acc, k: acc + F.coalesce(leg(matrix, F.get(r, k - 1), F.get(r, k)), F.lit(NO_EDGE)))

    def reversed_segment(r, i, j):
        return F.concat(F.slice(r, F.lit(1), i), F.reverse(F.slice(r, i + 1, j - i + 1)), F.slice(r, j + 2, F.greatest(n - j - 1, F.lit(0))))

    # segments (i, j) with 1 <= i < j <= n - 2, in order
    idx = _upto(n - 1)
    segments = F.flatten(F.transform(idx, lambda i: F.transform(F.filter(idx, lambda j: j > i), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    start = F.struct(order.alias("r"), cost(order).alias("c"), F.lit(True).alias("go"))

    def one_pass(acc, _):
        tries = F.transform(segments, lambda s: reversed_segment(acc["r"], s["i"], s["j"]))
        scored = F.transform(tries, lambda r: F.struct(r.alias("r"), cost(r).alias("c"), F.lit(True).alias("go")))
        better = F.get(F.filter(scored, lambda s: s["c"] < acc["c"]), F.lit(0))
        stop = F.struct(acc["r"].alias("r"), acc["c"].alias("c"), F.lit(False).alias("go"))
        return F.when(acc["go"], F.coalesce(better, stop)).otherwise(acc)

    passes = F.sequence(F.lit(1), F.lit(max_passes))
    return F.when(n < 4, order).otherwise(F.aggregate(passes, start, one_pass).getField("r"))


def all_orders(req: DataFrame, max_stops: int = 8, budget: str | None = None, carry: list[str] = ()) -> DataFrame:
    """Every feasible order of requests with at most ``max_stops`` stops after the start, grown stop by stop.

    Rows never leave their task; a partial route over the budget or without an edge is dropped at once, which is
    exact because times only grow. ``code`` writes the order as digits to the base ``max_stops + 1``.
    """
    base = req.filter(F.col("n") - 1 <= max_stops).select(
        "req_id", *carry, "n", "dur", "tm", "dm", F.array(F.lit(0)).alias("ord"), _upto(F.col("n")).alias("rem"),
        F.get("dur", F.lit(0)).alias("t"), F.lit(0).cast("bigint").alias("d"), F.lit(0).cast("bigint").alias("code"), *([budget] if budget else []))
    for _ in range(max_stops):
        grown = base.withColumn("nxt", F.explode_outer("rem"))
        cur = F.element_at("ord", -1)
        more = F.col("nxt").isNotNull()
        base = grown.withColumns({
            "t": F.when(more, F.col("t") + leg("tm", cur, F.col("nxt")) + F.get("dur", F.col("nxt"))).otherwise(F.col("t")),
            "d": F.when(more, F.col("d") + leg("dm", cur, F.col("nxt"))).otherwise(F.col("d")),
            "code": F.when(more, F.col("code") * (max_stops + 1) + F.col("nxt")).otherwise(F.col("code")),
            "ord": F.when(more, F.concat("ord", F.array("nxt"))).otherwise(F.col("ord")),
            "rem": F.when(more, F.array_remove("rem", F.col("nxt"))).otherwise(F.col("rem"))}).drop("nxt").filter("t is not null")
        if budget:
            base = base.filter(F.col("t") <= F.col(budget))
    return base.drop("rem", "tm", "dm", "dur")


def best_orders(req: DataFrame, max_stops: int = 8, budget: str | None = None) -> DataFrame:
    """Least total time per request, and the first such order: (req_id, n_feasible, total_time, ord, method).

    Up to ``max_stops`` stops after the start all orders are tried (method ``exact``; no row if none is feasible): time and
    order ride in one whole number, so that the aggregate is a plain minimum that combines in each task. Longer requests
    get the nearest-neighbour order (method ``greedy``, n_feasible null), whether or not it is within the budget.
    """
    base = max_stops + 1
    shift = base ** max_stops
    orders = all_orders(req, max_stops, budget).select("req_id", "n", (F.col("t") * shift + F.col("code")).alias("packed"))
    best = orders.groupBy("req_id", "n").agg(F.min("packed").alias("packed"), F.count("*").alias("n_feasible"))
    code = F.pmod(F.col("packed"), F.lit(shift))
    digits = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - 1, F.lit(1))),
                         lambda k: F.pmod(F.floor(code / F.pow(F.lit(float(base)), F.col("n") - 1 - k)), F.lit(base)).cast("int"))
    order = F.when(F.col("n") == 1, F.array(F.lit(0))).otherwise(F.concat(F.array(F.lit(0)), digits))
    exact = best.select("req_id", "n_feasible", F.expr(f"packed div {shift}").alias("total_time"), order.alias("ord"), F.lit("exact").alias("method"))
    longer = pin(req.filter(F.col("n") - 1 > max_stops), near=nearest_order(_upto(F.col("n"))))
    greedy = longer.select("req_id", F.lit(None).cast("bigint").alias("n_feasible"), total_time(F.col("near")).alias("total_time"), F.col("near").alias("ord"), F.lit("greedy").alias("method"))
    return exact.unionByName(greedy.filter("total_time is not null"))


# -- subsets under a budget ------------------------------------------------------------------------------------

def fits(places: Column, budget: Column) -> Column:
    # the one-element transform binds the order: its stops are read many times, and each read would make it again
    time = F.get(F.transform(F.array(nearest_order(places)), total_time), F.lit(0))
    # legs take no negative time, so visits that are too long alone need no order
    return F.coalesce(F.when((F.size(places) > 0) & (pick_sum(places, "dur") <= budget), time <= budget), F.lit(False))


def greedy_fill(ranked: Column, budget: Column) -> Column:
    """Add stops in ranked order while the set still fits, then offer the rest again until nothing is added."""
    empty = F.filter(ranked, lambda x: F.lit(False))
    add = lambda acc, p: F.when(~F.array_contains(acc, p) & fits(F.concat(acc, F.array(p)), budget), F.concat(acc, F.array(p))).otherwise(acc)
    first = F.aggregate(ranked, empty, add)
    given = F.array_sort(ranked)
    # a pass runs only if the pass before it added something
    start = F.struct(first.alias("sel"), F.lit(-1).alias("before"))
    again = lambda acc, _: F.when(F.size(acc["sel"]) == acc["before"], acc).otherwise(
        F.struct(F.aggregate(given, acc["sel"], add).alias("sel"), F.size(acc["sel"]).alias("before")))
    return F.aggregate(ranked, start, again).getField("sel")


# Labels of the ranking strategies.
RANKINGS = ["closest first", "shortest visits", "near + short", "satisfaction density", "your priorities", "satisfaction", "lowest cost"]


def rankings(weights: dict = WEIGHTS) -> list[Column]:
    """Stops 1..n-1 ordered by each strategy; the index breaks ties."""
    stops = _upto(F.col("n"))
    near = lambda i: F.coalesce(leg("tm", F.lit(0), i), F.lit(NO_EDGE))
    dur = lambda i: F.get("dur", i)
    sat = lambda i: F.get("sat", i)
    cost = lambda i: F.get("cost", i)
    value = lambda i: weights["attraction"] * sat(i) * 10 + weights["budget"] * (1 / (1 + cost(i) / 1000))
    density = lambda i: sat(i) / F.greatest(dur(i) / MICRO, F.lit(1.0))

    def by(*keys):
        return F.transform(F.array_sort(F.transform(stops, lambda i: F.struct(*[k(i).alias(f"k{p}") for p, k in enumerate(keys)], i.alias("i")))), lambda s: s["i"])

    return [by(near), by(dur), by(near, dur), by(lambda i: -density(i)), by(lambda i: -value(i)), by(lambda i: -sat(i)), by(cost)]


def subset_options(req: DataFrame, budget: str = "budget", max_options: int = 6, weights: dict = WEIGHTS, seeds: int = 5) -> DataFrame:
    """Subsets of the stops that fit the budget: most places first, then satisfaction. When the whole request
    fits it is the only option. Rows: (req_id, opt, label, chosen, time, satisfaction, fitted_all)."""
    b = F.col(budget)
    req = pin(req, **{f"rk{i}": r for i, r in enumerate(rankings(weights))})
    near = F.col("rk0")
    everything = _upto(F.col("n"))
    packs = [F.struct(F.lit(f"Max places ({name})").alias("label"), greedy_fill(F.col(f"rk{i}"), b).alias("chosen")) for i, name in enumerate(RANKINGS)]
    grown = F.transform(F.slice(near, 1, seeds), lambda p: F.struct(
        F.concat(F.lit("Max pack from "), F.get("stops", p).cast("string")).alias("label"),
        greedy_fill(F.concat(F.array(p), F.array_remove(near, p)), b).alias("chosen")))
    whole = F.array(F.struct(F.lit("All places").alias("label"), everything.alias("chosen")))
    every = F.when(fits(everything, b), whole).otherwise(F.concat(F.array(*packs), grown))
    opts = (req.filter("n > 1").select("*", F.posexplode_outer(every).alias("strategy", "o"))
            .withColumn("chosen", F.col("o.chosen")).withColumn("label", F.col("o.label")).filter(F.size("chosen") > 0)
            .withColumn("key", F.array_sort("chosen")))
    opts = pin(opts, route=nearest_order(F.col("chosen")))
    opts = pin(opts, time=total_time(F.col("route")), satisfaction=F.round(pick_sum(F.col("chosen"), "sat"), 2))
    opts = opts.select("req_id", "n", "strategy", "label", "chosen", "key", "time", "satisfaction")  # matrices stay behind
    first = W.partitionBy("req_id", "key").orderBy("strategy")
    opts = opts.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1")
    rank = W.partitionBy("req_id").orderBy(F.desc(F.size("chosen")), F.desc("satisfaction"), "strategy")
    top = W.partitionBy("req_id")
    opts = opts.withColumn("max_n", F.max(F.size("chosen")).over(top)).filter((F.col("max_n") < 3) | (F.size("chosen") >= F.col("max_n") - 1))
    return (opts.withColumn("opt", F.row_number().over(rank)).filter(F.col("opt") <= max_options)
            .select("req_id", "opt", "label", "chosen", "time", "satisfaction", (F.size("chosen") == F.col("n") - 1).alias("fitted_all")))


# -- candidates and their scores ----------------------------------------------------------------------------------

def variants(order: Column) -> Column:
    """Adjacent swaps, then reversals of 2, 3 and 4 stops; the start stays, repeats are dropped."""
    n = F.size(order)

    def cut(i, length):
        return F.concat(F.slice(order, F.lit(1), i), F.reverse(F.slice(order, i + 1, F.lit(length))), F.slice(order, i + length + 1, F.greatest(n - i - length, F.lit(0))))

    parts = []
    for length in (2, 3, 4):
        # the reversal of 2 also covers the adjacent swap at the end of the route
        last = n - length + (1 if length == 2 else 0)
        parts.append(_cuts(n, length, last, cut))
    return F.array_except(F.array_distinct(F.concat(*parts)), F.array(order))


def _cuts(n, length, last, cut):
    starts = F.slice(_upto(n), F.lit(1), F.greatest(last - 1, F.lit(0)))
    return F.transform(starts, lambda i: cut(i, length))


def prefixes(order: Column) -> Column:
    """The route cut after each stop, from two places on."""
    return F.transform(_upto(F.size(order)), lambda k: F.slice(order, F.lit(1), k + 1))


def candidates(req: DataFrame) -> DataFrame:
    """Nearest-neighbour route, its improved form, their variants and prefixes: one row per distinct route."""
    base = pin(pin(req, nn=nearest_order(_upto(F.col("n")))), opt=two_opt(F.col("nn")))
    pool = F.array_distinct(F.concat(F.array("nn", "opt"), variants(F.col("nn")), prefixes(F.col("nn"))))
    return route_metrics(base.withColumn("ord", F.explode_outer(pool)).drop("nn", "opt"))


def route_metrics(df: DataFrame) -> DataFrame:
    """Totals of ``ord`` per row; routes with a missing leg are dropped."""
    o = F.col("ord")
    return pin(df, total_time=total_time(o), total_distance=path_sum(o, "dm"), total_cost=pick_sum(o, "cost"),
               total_satisfaction=F.round(pick_sum(o, "sat"), 6), n_places=F.size(o)).filter("total_time is not null")


def legs_table(df: DataFrame, key: list[str]) -> DataFrame:
    """One row per stop of ``ord``: visit time, and travel and distance from the previous stop (0 for the first)."""
    o = F.col("ord")
    at = F.get(o, F.col("pos"))
    before = F.get(o, F.col("pos") - 1)
    rows = df.select(*key, "ord", "n", "stops", "dur", "tm", "dm", F.explode(F.sequence(F.lit(0), F.size("ord") - 1)).alias("pos"))
    first = F.col("pos") == 0
    return rows.select(*key, (F.col("pos") + 1).alias("leg_no"), F.get("stops", at).alias("place_id"), F.get("dur", at).alias("visit"),
                       F.when(first, 0).otherwise(leg("tm", before, at)).cast("bigint").alias("travel"),
                       F.when(first, 0).otherwise(leg("dm", before, at)).cast("bigint").alias("distance"))


def day_split(order: Column, days: Column, hours: Column) -> Column:
    """Fold over the stops: a new day starts when the current one has stops, would overflow, and days remain.

    Returns array<struct<day, places, time, distance, within>>; the travel into a day is charged to that day.
    """
    limit = (hours * 60 * MICRO).cast("bigint")
    day_type = "array<struct<day:int,places:array<bigint>,time:bigint,distance:bigint>>"
    start = F.expr(f"cast(array() as {day_type})")

    def step(acc, k):
        i = F.get(order, k)
        first = k == 0
        travel = F.when(first, F.lit(0)).otherwise(F.coalesce(leg("tm", F.get(order, k - 1), i), F.lit(0))).cast("bigint")
        dist = F.when(first, F.lit(0)).otherwise(F.coalesce(leg("dm", F.get(order, k - 1), i), F.lit(0))).cast("bigint")
        add = F.get("dur", i) + travel
        place = F.get("stops", i)
        cur = F.try_element_at(acc, F.lit(-1))
        fresh = F.struct((F.size(acc) + 1).alias("day"), F.array(place).alias("places"), add.alias("time"), dist.alias("distance"))
        longer = F.struct(cur["day"].alias("day"), F.concat(cur["places"], F.array(place)).alias("places"), (cur["time"] + add).alias("time"), (cur["distance"] + dist).alias("distance"))
        new_day = (F.size(acc) == 0) | ((cur["time"] + add > limit) & (cur["day"] < days))
        return F.when(new_day, F.concat(acc, F.array(fresh))).otherwise(
            F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer)))

    split = F.aggregate(F.sequence(F.lit(0), F.size(order) - 1), start, step)
    return F.transform(split, lambda d: F.struct(d["day"].alias("day"), d["places"].alias("places"), d["time"].alias("time"),
                                                 d["distance"].alias("distance"), (d["time"] <= limit).alias("within")))


def _with_pairs(rows: DataFrame, items: str, keep: list[str], own: bool = False) -> DataFrame:
    """(*keep, a, b): the pairs a < b of a sorted array; with ``own`` also (a, a)."""
    at = rows.select(*dict.fromkeys([*keep, items]), F.posexplode(items).alias("_i", "a"))
    return at.select(*keep, "a", F.explode(F.slice(items, F.col("_i") + (1 if own else 2), F.size(items))).alias("b"))


def history_index(trips: DataFrame, key: str = "trip_id", max_len: int = 10, busy: int = 256) -> tuple[DataFrame, DataFrame | None, int]:
    """Distinct sets of past trips and the busy pairs of places (more than ``busy`` sets hold them; None if there are none).

    ``max_len``: trips with a busy pair are found by all their subsets up to this length, and by their places beyond it.
    """
    from placelore.session import stored

    past = stored(trips.groupBy(key).agg(F.array_sort(F.collect_set("place_id")).alias("set")).select("set").distinct())
    heavy = stored(_with_pairs(past, "set", []).groupBy("a", "b").agg(F.count("*").alias("c")).filter(F.col("c") > busy).select("a", "b"))
    return past, None if heavy.isEmpty() else heavy, max_len


def subsets(items: Column) -> Column:
    """All non-empty subsets of a sorted array, each in order."""
    empty = F.array(F.filter(items, lambda x: F.lit(False)))
    grown = F.aggregate(items, empty, lambda acc, x: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(x)))))
    return F.filter(grown, lambda s: F.size(s) > 0)


def path_similarity(paths: DataFrame, key: str, lengths, past: DataFrame, heavy: DataFrame | None, max_len: int) -> DataFrame:
    """(key, best): for each of ``lengths(n)`` the best Jaccard between the first stops of ``path`` and any past trip.
    Paths without any overlap are left out.

    ``paths``: (key, path), stops distinct, n of them. A trip that shares two places with a path is met at each shared pair,
    one that shares a single place can only be the shortest trip of that place. So trips and paths meet by equal pairs, where
    few trips wait; pairs that many trips hold are left to an index of subsets, whose size does not depend on how often they meet.
    """
    # partitions follow the data: adaptive execution joins small ones only where no number is given
    tasks = max(int(past.sparkSession.conf.get("spark.sql.shuffle.partitions")), past.count() // 100_000)
    # a single place stands for its shortest trip
    single = (past.select(F.explode("set").alias("a"), F.size("set").alias("len")).groupBy("a").agg(F.min("len").alias("len"))
              .select("a", F.col("a").alias("b"), F.array("a").alias("trip"), "len"))
    pairs = _with_pairs(past, "set", ["set"])
    if heavy is not None:
        pairs = pairs.join(heavy, ["a", "b"], "left_anti")
    waiting = (pairs.select("a", "b", F.col("set").alias("trip"), F.size("set").alias("len")).unionByName(single).repartition(tasks, "a", "b")
               .groupBy("a", "b").agg(F.collect_list(F.struct("trip", "len")).alias("trips")))
    asked = _with_pairs(paths.withColumn("_s", F.array_sort("path")), "_s", [key, "path"], own=True)

    def jaccard(k):
        shared = F.transform("trips", lambda t: F.struct(F.size(F.array_intersect(F.slice("path", F.lit(1), k), t["trip"])).alias("c"), t["len"].alias("len")))
        return F.array_max(F.transform(shared, lambda x: x["c"] / (k + x["len"] - x["c"])))

    ks = lengths(F.size("path"))
    found = asked.repartition(tasks, "a", "b").join(waiting, ["a", "b"]).select(key, F.transform(ks, jaccard).alias("best"))
    if heavy is not None:
        among = _with_pairs(past, "set", ["set"]).join(heavy, ["a", "b"], "left_semi").select("set").distinct()
        prefix = (_with_pairs(paths.withColumn("_s", F.array_sort("path")), "_s", [key, "path"]).join(heavy, ["a", "b"], "left_semi").select(key, "path").distinct()
                  .select(key, ks.alias("ks"), "path", F.explode(ks).alias("k")).withColumn("set", F.array_sort(F.slice("path", F.lit(1), F.col("k")))))
        dense = prefix.join(_subset_similarity(prefix.select("set").distinct(), among, max_len), "set")
        found = found.unionByName(dense.select(key, F.transform("ks", lambda x: F.when(x == F.col("k"), F.col("similarity")).otherwise(0.0)).alias("best")))
    best = found.repartition(tasks, key).groupBy(key).agg(F.collect_list("best").alias("bs"))
    return best.select(key, F.transform(F.get("bs", F.lit(0)), lambda _, i: F.array_max(F.transform("bs", lambda x: F.get(x, i)))).alias("best"))


def _subset_similarity(sets: DataFrame, trips: DataFrame, max_len: int) -> DataFrame:
    """(set, similarity) from distinct (set) on both sides.

    For a route R and a trip T, J = |S| / (|R| + |T| - |S|) with S = their intersection, so the best J over all
    trips is the best over the subsets S of R of |S| / (|R| + min|T| - |S|), min over trips holding S. The index is
    a map-side-combined minimum and no pairs of trips are formed. Trips longer than ``max_len`` would have too
    many subsets; they meet by their places.
    """
    short_trips = trips.filter(F.size("set") <= max_len)
    index = (short_trips.select(F.size("set").alias("len"), F.explode(subsets(F.col("set"))).alias("sub"))
             .groupBy("sub").agg(F.min("len").alias("min_len")))
    size = F.size("set")
    short = sets.filter(size <= max_len).select("set", F.explode(subsets(F.col("set"))).alias("sub"))
    by_subset = (short.join(index, "sub").select("set", (F.size("sub") / (size + F.col("min_len") - F.size("sub"))).alias("j")))
    # element join for long trips against any set, and for long sets against any trip (both exact)
    rows = lambda df, name: df.select(F.col("set").alias(name), F.explode("set").alias("item"))
    against_long = rows(sets, "set").join(rows(trips.filter(size > max_len), "trip"), "item").groupBy("set", "trip").agg(F.count("*").alias("c"))
    jl = against_long.select("set", (F.col("c") / (size + F.size("trip") - F.col("c"))).alias("j"))
    against_short = rows(sets.filter(size > max_len), "set").join(rows(short_trips, "trip"), "item").groupBy("set", "trip").agg(F.count("*").alias("c"))
    js = against_short.select("set", (F.col("c") / (size + F.size("trip") - F.col("c"))).alias("j"))
    best = by_subset.unionByName(jl).unionByName(js).groupBy("set").agg(F.max("j").alias("similarity"))
    return sets.join(best, "set", "left").select("set", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def history_similarity(sets: DataFrame, past: DataFrame, heavy: DataFrame | None, max_len: int) -> DataFrame:
    """``sets``: distinct (set) arrays of place ids, sorted; the rest is what ``history_index`` returns. Returns (set, similarity),
    0 without any overlap."""
    paths = sets.select("set", F.col("set").alias("path"))
    best = path_similarity(paths, "set", lambda n: F.array(n), past, heavy, max_len)
    return sets.join(best, "set", "left").select("set", F.coalesce(F.get("best", F.lit(0)), F.lit(0.0)).alias("similarity"))


def scaled(value: Column, low: Column, high: Column, higher_better: bool = True) -> Column:
    v = (value - low) / (high - low)
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return F.when(low == high, 1.0).otherwise(v if higher_better else 1.0 - v)


def _preference(s, weights: dict) -> Column:
    """The weighted sum; ``s(column, higher_better)`` gives a value scaled within its pool."""
    user = (weights["attraction"] * s("total_satisfaction", True) + weights["budget"] * s("total_cost", False)
            + weights["time"] * s("total_time", False) + weights["popular"] * s("similarity", True) + 0.10 * s("total_distance", False))
    return 0.75 * user + 0.25 * s("n_places", True)


def preference_scores(routes: DataFrame, weights: dict = WEIGHTS, by=("req_id",), name: str = "preference_score") -> DataFrame:
    """Min-max scaling within each request's pool, then the weighted sum; a pool is bounded by its request."""
    w = W.partitionBy(*by)
    s = lambda c, up: scaled(F.col(c), F.min(c).over(w), F.max(c).over(w), up)
    return routes.withColumn(name, _preference(s, weights))


# a pool as an array in its request's row: what is said of routes of one request needs no shuffle

def route_pool(req: DataFrame, trips: DataFrame) -> DataFrame:
    """(req_id, routes): the nearest-neighbour route with its variants and prefixes, repeats and routes with a missing leg left out.

    A route has the places of the first stops of the nearest-neighbour route, so likeness to past trips is asked once per
    prefix. Requests whose nearest-neighbour route has a missing leg have no pool.
    """
    base = pin(pin(req, nn=nearest_order(_upto(F.col("n")))), nn_time=total_time(F.col("nn"))).filter("nn_time is not null")
    paths = base.select("req_id", F.transform("nn", lambda i: F.get("stops", i)).alias("path"))
    alike = path_similarity(paths, "req_id", lambda n: F.sequence(F.lit(1), n), *history_index(trips))
    orders = F.array_distinct(F.concat(F.array("nn"), variants(F.col("nn")), prefixes(F.col("nn"))))
    route = lambda o: F.struct(
        route_key(o).alias("route_key"), total_time(o).alias("total_time"), path_sum(o, "dm").alias("total_distance"), pick_sum(o, "cost").alias("total_cost"),
        F.round(pick_sum(o, "sat"), 6).alias("total_satisfaction"), F.size(o).alias("n_places"), F.coalesce(F.get("best", F.size(o) - 1), F.lit(0.0)).alias("similarity"),
        pick_sum(o, "dur").alias("total_visit"))
    return pin(base.join(alike, "req_id", "left"), routes=F.transform(orders, route)).select("req_id", F.filter("routes", lambda r: r["total_time"].isNotNull()).alias("routes"))


def pool_scores(pools: DataFrame, routes: str, weights: dict = WEIGHTS, name: str = "preference_score") -> DataFrame:
    """``preference_scores`` for pools that are arrays: the field ``name`` is added to the elements of ``routes``."""
    cols = ["total_satisfaction", "total_cost", "total_time", "similarity", "total_distance", "n_places"]
    ends = [f(F.transform(routes, lambda r: r[c])).alias(f"{c}_{end}") for c in cols for end, f in (("low", F.array_min), ("high", F.array_max))]  # noqa: B023
    pools = pin(pools, _ends=F.struct(*ends))
    s = lambda r: lambda c, up: scaled(r[c], F.col(f"_ends.{c}_low"), F.col(f"_ends.{c}_high"), up)
    return pools.withColumn(routes, F.transform(routes, lambda r: r.withField(name, _preference(s(r), weights)))).drop("_ends")


def _beats(a: Column, b: Column) -> Column:
    ends = [(a[c], b[c]) if sign > 0 else (b[c], a[c]) for c, sign in OBJECTIVES]
    return reduce(lambda x, y: x & y, [p >= q for p, q in ends]) & reduce(lambda x, y: x | y, [p > q for p, q in ends])


def pool_front(routes: str) -> Column:
    """The routes of a pool that no other one dominates."""
    return F.filter(routes, lambda b: ~F.exists(routes, lambda a: _beats(a, b)))


def rank_pool(pools: DataFrame, weights: dict = WEIGHTS, min_results: int = 4) -> DataFrame:
    """``rank_routes`` for pools that are arrays: (req_id, rank, in_front, the fields of the routes)."""
    pools = pin(pools, front=pool_front("routes"))
    pools = pool_scores(pool_scores(pools, "routes", weights), "front", weights)
    keys = F.transform("front", lambda r: r["route_key"])
    best = lambda rs: F.transform(F.array_sort(F.transform(rs, lambda r: F.struct(
        (-F.round(r["preference_score"], 9)).alias("s"), r["route_key"].alias("k"), r.alias("r")))), lambda x: x["r"])
    rest = best(F.filter("routes", lambda r: ~F.array_contains(keys, r["route_key"])))
    ranked = F.concat(best("front"), F.slice(rest, F.lit(1), F.greatest(F.lit(0), min_results - F.size("front"))))
    rows = pools.select("req_id", F.size("front").alias("_f"), F.posexplode(ranked).alias("_p", "_r"))
    return rows.select("req_id", (F.col("_p") + 1).alias("rank"), F.when(F.col("_p") < F.col("_f"), 1).otherwise(0).alias("in_front"), "_r.*")


def normalize_weights(weights: dict[str, float]) -> dict[str, float]:
    total = sum(max(float(v), 0.0) for v in weights.values())
    return {k: (max(float(v), 0.0) / total if total else 1 / len(weights)) for k, v in weights.items()}


OBJECTIVES = [("total_satisfaction", 1), ("total_cost", -1), ("total_time", -1), ("similarity", 1)]


def pareto_front(routes: DataFrame, by: str = "req_id", route: str = "ord", chunk: int = 64) -> DataFrame:
    """Routes of a request that no other one dominates.

    Points are folded to distinct objective vectors, thinned inside hash chunks of bounded size, and only the
    survivors are compared with each other. Dominance is transitive, so thinning first changes nothing.
    """
    cols = [c for c, _ in OBJECTIVES]
    pts = routes.select(by, *cols).distinct()
    pt = F.struct(*[(F.col(c) * sign).cast("double").alias(f"o{i}") for i, (c, sign) in enumerate(OBJECTIVES)], *cols)
    beats = lambda a, b: (a["o0"] >= b["o0"]) & (a["o1"] >= b["o1"]) & (a["o2"] >= b["o2"]) & (a["o3"] >= b["o3"]) & (
        (a["o0"] > b["o0"]) | (a["o1"] > b["o1"]) | (a["o2"] > b["o2"]) | (a["o3"] > b["o3"]))
    sizes = pts.groupBy(by).agg(F.ceil(F.count("*") / chunk).alias("chunks"))
    parts = (pts.join(sizes, by).withColumn("part", F.pmod(F.xxhash64(*cols), F.col("chunks")))
             .groupBy(by, "part", "chunks").agg(F.collect_list(pt).alias("ps"))
             .withColumn("ps", F.filter("ps", lambda b: ~F.exists("ps", lambda a: beats(a, b)))))
    alive = parts.select(by, "part", "chunks", F.explode("ps").alias("p"))
    # across chunks: survivors of one chunk against the (thinned) arrays of the others of the same request
    several = alive.filter("chunks > 1").alias("x").join(
        parts.filter("chunks > 1").select(F.col(by).alias("_by"), F.col("part").alias("_part"), F.col("ps").alias("_ps")),
        (F.col(by) == F.col("_by")) & (F.col("part") != F.col("_part")) & F.exists("_ps", lambda a: beats(a, F.col("p"))), "left_anti")
    front = alive.filter("chunks = 1").unionByName(several).select(by, *[F.col(f"p.{c}").alias(c) for c in cols])
    return routes.join(front, [by, *cols], "left_semi")


def rank_routes(routes: DataFrame, weights: dict = WEIGHTS, min_results: int = 4) -> DataFrame:
    """Front first (scored within itself), then the full order until ``min_results`` are there."""
    scored = preference_scores(routes, weights)
    front = preference_scores(pareto_front(routes), weights).withColumn("in_front", F.lit(1))
    keys = ["req_id", "route_key"]
    rest = scored.join(front.select(*keys), keys, "left_anti").withColumn("in_front", F.lit(0))
    both = front.unionByName(rest)
    w = W.partitionBy("req_id").orderBy(F.desc("in_front"), F.desc(F.round("preference_score", 9)), "route_key")
    return both.withColumn("rank", F.row_number().over(w)).filter((F.col("in_front") == 1) | (F.col("rank") <= min_results))


def front_indicators(points: DataFrame) -> DataFrame:
    """GD, IGD and spread per request from (req_id, side, satisfaction, cost, similarity), side in {a, r}; each
    side is scaled by its own range. A request's points are few; distances are taken inside its row."""
    pt = F.struct("total_satisfaction", "total_cost", "similarity")
    side = lambda x: F.collect_list(F.when(F.col("side") == x, pt)).alias(x)
    return pool_indicators(points.groupBy("req_id").agg(side("a"), side("r")), "a", "r")


def pool_indicators(pools: DataFrame, found: str, best: str) -> DataFrame:
    """``front_indicators`` of two arrays of points in one row."""
    def points(side):
        at = lambda c: F.transform(side, lambda p: p[c])
        ends = {c: (F.array_min(at(c)), F.array_max(at(c))) for c in ("total_satisfaction", "total_cost", "similarity")}
        bound = F.struct(*[e.alias(f"{c}_{i}") for c, lowhigh in ends.items() for i, e in enumerate(lowhigh)])
        s = lambda p, b, c, up: scaled(p[c], b[f"{c}_0"], b[f"{c}_1"], up)
        # the one-element array binds the bounds, which are then read without being made again
        return F.flatten(F.transform(F.array(bound), lambda b: F.transform(side, lambda p: F.struct(
            s(p, b, "total_satisfaction", True).alias("x"), s(p, b, "total_cost", False).alias("y"), s(p, b, "similarity", True).alias("z")))))

    rows = pin(pools, _a=points(found), _r=points(best))
    dist = lambda p, q: F.sqrt(F.pow(p["x"] - q["x"], F.lit(2)) + F.pow(p["y"] - q["y"], F.lit(2)) + F.pow(p["z"] - q["z"], F.lit(2)))
    near = lambda side, other: F.transform(side, lambda p: F.array_min(F.transform(other, lambda q: dist(p, q))))
    total = lambda arr, f: F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + f(x))
    span = lambda f: F.array_max(F.transform("_a", lambda p: p[f])) - F.array_min(F.transform("_a", lambda p: p[f]))
    both = (F.size("_a") > 0) & (F.size("_r") > 0)
    return rows.select("req_id",
                       F.when(both, F.sqrt(total(near(F.col("_a"), F.col("_r")), lambda x: x * x) / F.size("_a"))).alias("gd"),
                       F.when(both, total(near(F.col("_r"), F.col("_a")), lambda x: x) / F.size("_r")).alias("igd"),
                       F.when(F.size("_a") > 0, F.sqrt(sum((F.pow(span(f), F.lit(2)) for f in "xyz"), F.lit(0.0)))).alias("ms"))


def detailed_scores(routes: DataFrame, weights: dict = WEIGHTS) -> DataFrame:
    """Seven components and the overall score; expects similarity, total_visit, bad_places and checked_places."""
    n, t, d = F.greatest(F.col("n_places"), F.lit(1)), F.greatest(F.col("total_time") / MICRO, F.lit(1.0)), F.greatest(F.col("total_distance") / MICRO, F.lit(1.0))
    ideal_t, ideal_d = n * 90 + (n - 1) * 40, (n - 1) * 40
    sat = F.least(F.lit(1.0), F.col("total_satisfaction") / (n * 3.5))
    time = F.greatest(F.lit(0.0), 1 - F.abs(t - ideal_t) / F.greatest(t, ideal_t))
    dist = F.greatest(F.lit(0.0), 1 - F.abs(d - ideal_d) / F.greatest(d, ideal_d, F.lit(1.0)))
    cost = 1 / (1 + F.col("total_cost") / 5000)
    weather = F.when(F.col("checked_places") > 0, 1 - F.col("bad_places") / F.col("checked_places")).otherwise(1.0)
    stay = 1 - F.least(F.lit(1.0), F.abs(F.col("total_visit") / MICRO / n - 120) / 180)
    w = weights
    return routes.withColumns({"s_satisfaction": sat, "s_time": time, "s_distance": dist, "s_budget": cost, "s_popular": F.col("similarity"), "s_weather": weather, "s_stay": stay}).withColumn(
        "overall", w["attraction"] * F.col("s_satisfaction") + w["budget"] * F.col("s_budget") + w["time"] * F.col("s_time") + w["popular"] * F.col("s_popular")
        + 0.10 * F.col("s_distance") + 0.05 * F.col("s_weather") + 0.05 * F.col("s_stay"))


ROUTE_NOTES = {"goal": "ranked by {weight}", "size": "{places} stops, {hours} h, {km} km", "roads_good": "little time on the road", "roads_poor": "much time on the road",
               "weather_bad": "bad weather at: {bad}", "weather_good": "weather fine"}


def explain_route(top_weight: str, df_cols: dict[str, Column], notes: dict[str, str] = ROUTE_NOTES) -> Column:
    """Notes on a route, joined by semicolons: what it is ranked by, its size, share of road time, weather.

    ``df_cols``: places, hours, km, efficiency (time on site by all time), bad (names of places with bad weather, empty
    if there are none). ``notes`` are templates, so texts of one's own need no code.
    """
    c = df_cols | {"weight": F.lit(top_weight)}
    return F.concat_ws("; ", fill(notes["goal"], c), fill(notes["size"], c), F.when(c["efficiency"] >= 0.6, fill(notes["roads_good"], c)).when(c["efficiency"] < 0.4, fill(notes["roads_poor"], c)),
                       F.when(F.coalesce(c["bad"], F.lit("")) != "", fill(notes["weather_bad"], c)).otherwise(fill(notes["weather_good"], c)))


def day_label(labels: Column) -> Column:
    """'(no places)', the place, 'start-A → end-B', or all of them between start and end."""
    n = F.size(labels)
    mid = F.slice(labels, F.lit(2), F.greatest(n - 2, F.lit(0)))
    first, last = F.get(labels, F.lit(0)), F.get(labels, n - 1)
    return (F.when(n == 0, "(no places)").when(n == 1, first)
            .otherwise(F.array_join(F.concat(F.array(F.concat(F.lit("start-"), first)), mid, F.array(F.concat(F.lit("end-"), last))), " → ")))


def place_label(name: Column, category: Column) -> Column:
    c = F.trim(F.coalesce(category, F.lit("")))
    return F.when(c == "", name).otherwise(F.concat(name, F.lit(" ("), c, F.lit(")")))


# -- sampled walks -------------------------------------------------------------------------------------------------

def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) from a hash of the keys: the same on every attempt of a task."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(2 ** 31 - 1)) + 1) / float(2 ** 31 + 1)


def sampled_walks(req: DataFrame, walkers: int = 8, iterations: int = 3, budget: str = "budget", seed: int = 42,
                  weights: dict = WEIGHTS, decay: float = 0.1) -> DataFrame:
    """Walkers are rows. Each draws its next stop with probability proportional to the stop's weight (the least
    -ln(u)/weight wins), within the time budget. After each iteration edge weights decay and the best walk of the
    request adds to its edges. Weights live in the request's row, so an iteration is one grouping by request.

    Returns all full walks: (req_id, iteration, walker, ord, total_time, total_satisfaction).
    """
    from placelore.session import durable, union_all

    state = req.withColumn("ph", F.transform("tm", lambda x: F.when(x.isNotNull(), 1.0)))
    found = []
    for it in range(iterations):
        walks = state.withColumn("walker", F.explode(F.sequence(F.lit(1), F.lit(walkers))))
        start = F.struct(F.array(F.lit(0)).alias("ord"), _upto(F.col("n")).alias("rem"), F.get("dur", F.lit(0)).alias("t"))

        def step(acc, k):
            cur = F.element_at(acc["ord"], -1)

            def weigh(x):
                t, d = leg("tm", cur, x), leg("dm", cur, x)
                w = (100 + weights["popular"] * leg("ph", cur, x) + weights["time"] * 100 / F.greatest(t / MICRO, F.lit(1.0))
                     + weights["attraction"] * F.get("sat", x) * 20 + weights["budget"] * 20 / (1 + F.get("cost", x) / 1000) + 5 / F.greatest(d / MICRO, F.lit(1.0)))
                ok = t.isNotNull() & (acc["t"] + t + F.get("dur", x) <= F.col(budget))
                u = uniform(seed, F.col("req_id"), F.lit(it), F.col("walker"), k, x)
                return F.struct(F.when(ok, -F.log(u) / w).alias("key"), x.alias("x"), (acc["t"] + t + F.get("dur", x)).alias("t"))

            pick = F.array_min(F.filter(F.transform(acc["rem"], weigh), lambda s: s["key"].isNotNull()))
            # the one-element transform binds the draw, which is then read without being made again
            move = lambda s: F.when(s.isNull(), acc).otherwise(
                F.struct(F.concat(acc["ord"], F.array(s["x"])).alias("ord"), F.array_remove(acc["rem"], s["x"]).alias("rem"), s["t"].alias("t")))
            return F.get(F.transform(F.array(pick), move), F.lit(0))

        walks = (pin(walks, w=F.aggregate(_upto(F.col("n")), start, step)).filter((F.size("w.rem") == 0) & (F.size("w.ord") > 1))
                 .withColumn("ord", F.col("w.ord")).withColumn("total_time", F.col("w.t")).withColumn("total_satisfaction", pick_sum(F.col("ord"), "sat"))
                 .withColumn("gain", F.col("total_satisfaction") / F.greatest(F.col("total_time") / MICRO, F.lit(1.0))))
        walks = durable(walks.select("req_id", F.lit(it).alias("iteration"), "walker", "ord", "total_time", "total_satisfaction", "gain"))
        found.append(walks)
        if it + 1 < iterations:
            best = walks.groupBy("req_id").agg(F.max(F.struct("gain", (-F.col("walker")).alias("w"), "ord")).alias("b"))
            used = F.transform(_upto(F.size("b.ord")), lambda k: F.get("b.ord", k - 1) * F.col("n") + F.get("b.ord", k))
            state = state.join(best, "req_id", "left").withColumn("ph", F.transform("ph", lambda p, c: F.when(
                F.col("b").isNull(), p).otherwise(F.greatest(F.lit(0.01), p * (1 - decay)) + F.when(F.array_contains(used, c), F.col("b.gain")).otherwise(0.0)))).drop("b")
    return union_all(found).drop("gain")


# -- the whole plan ------------------------------------------------------------------------------------------------

def plan(req: DataFrame, trips: DataFrame, budget: str = "budget", days: int = 3, hours: float = 8, options: int = 5, top: int = 5,
         weights: dict = WEIGHTS) -> DataFrame:
    """Subsets that fit, candidate routes and variants of each, front-first ranking, and the day split of the best.

    Rows: (req_id, rank, route_key, in_front, preference_score, total_time, day_plan, reason). A request without any
    route has one row with the reason: a single stop, or nothing that fits the budget.
    """
    from placelore.session import durable

    opts = subset_options(req, budget, options, weights).select("req_id", "chosen")
    base = pin(req.join(opts, "req_id"), nn=nearest_order(F.col("chosen")))
    pool = F.array_distinct(F.concat(F.array("nn"), variants(F.col("nn"))))
    routes = route_metrics(base.withColumn("ord", F.explode_outer(pool))).filter(F.col("total_time") <= F.col(budget))
    key = route_key(F.col("ord"))
    routes = routes.select("req_id", key.alias("route_key"), F.array_sort(F.transform("ord", lambda i: F.get("stops", i))).alias("set"), "total_time", "total_distance",
                           "total_cost", "total_satisfaction", "n_places", day_split(F.col("ord"), F.lit(days), F.lit(hours)).alias("day_plan"))
    routes = durable(routes.dropDuplicates(["req_id", "route_key"]))
    scored = durable(routes.join(history_similarity(routes.select("set").distinct(), *history_index(trips)), "set").drop("set"))
    ranked = rank_routes(scored, weights, min_results=top)
    planned = ranked.filter(F.col("rank") <= top).select("req_id", "rank", "route_key", "in_front", "preference_score", "total_time", "day_plan", F.lit(None).cast("string").alias("reason"))
    without = req.select("req_id", "n").join(scored.select("req_id").distinct(), "req_id", "left_anti")
    why = F.when(F.col("n") == 1, "single stop").otherwise("nothing fits the budget")
    return planned.unionByName(without.select("req_id", why.alias("reason")), allowMissingColumns=True)


# -- rank among all orders, any length ----------------------------------------------------------------------

@lru_cache(maxsize=64)
def _grown(k: int, free: bool) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """How all orders of k stops grow stop by stop, and the orders themselves (in the order of ``permutations``).

    Each step names the shorter order that it extends and the cell of the flat leg matrix that it adds; orders start at
    row 0 of a matrix of k + 1 stops, or (``free``) at any of the k stops.
    """
    side = k if free else k + 1
    orders = np.arange(k)[:, None] if free else np.zeros((1, 1), np.int64)
    steps = []
    while orders.shape[1] < side:
        left = np.ones((len(orders), side), bool)
        left[np.arange(len(orders))[:, None], orders] = False
        before, stop = np.nonzero(left)
        steps.append((before, orders[before, -1] * side + stop))
        orders = np.column_stack([orders[before], stop])
    return steps, orders


def _order_sums(legs: np.ndarray, k: int, free: bool) -> np.ndarray:
    """Sums of legs of all orders, per row of ``legs`` (rows, cells)."""
    sums = np.zeros((len(legs), k if free else 1))
    for before, cell in _grown(k, free)[0]:
        sums = sums[:, before] + legs[:, cell]
    return sums


@lru_cache(maxsize=16)
def _layers(m: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """By size of a set of stops and the next stop: the sets without that stop, and the sets with it added."""
    sets = np.arange(1 << m)
    size = np.bitwise_count(sets)
    return [[(at, at | 1 << j) for j in range(m) for at in [sets[(size == k) & (sets >> j & 1 == 0)]]] for k in range(1, m)]


def _subset_bounds(legs: np.ndarray, largest: bool) -> float:
    """Least (or largest) sum of legs over all orders that start at 0, by programming over sets of visited stops, all sets of one size at once."""
    m = len(legs) - 1
    worst = -np.inf if largest else np.inf
    pick = np.maximum if largest else np.minimum
    cost = np.where(np.isfinite(legs), legs, worst)
    best = np.full((1 << m, m), worst)
    best[1 << np.arange(m), np.arange(m)] = cost[0, 1:]
    for layer in _layers(m):
        for j, (seen, grown) in enumerate(layer):
            best[grown, j] = pick.reduce(best[seen] + cost[1:, j + 1], axis=1)
    return float(pick.reduce(best[-1])) if m else 0.0


def _halves(legs: np.ndarray, below: float) -> tuple[int, int]:
    """(orders, orders with a sum under ``below``) of all that start at 0 and use no missing leg.

    Every order is cut after half of its stops. For each set of stops in the first half the sums of its orders and those
    of the rest are sorted by the stop at the cut, and pairs are counted by search; nothing is kept from set to set.
    """
    m = len(legs) - 1
    h = m // 2
    by_end = np.argsort(_grown(h, False)[1][:, -1], kind="stable")
    total = better = 0
    for chosen in combinations(range(1, m + 1), h):
        rest = [x for x in range(1, m + 1) if x not in chosen]
        head, tail = [0, *chosen], np.array(rest)
        # one row per stop before the cut, and per stop after it
        fronts = -np.sort(-_order_sums(legs[np.ix_(head, head)].reshape(1, -1), h, False)[0, by_end].reshape(max(h, 1), -1), axis=1)
        backs = np.sort(_order_sums(legs[np.ix_(tail, tail)].reshape(1, -1), m - h, True).reshape(m - h, -1), axis=1)
        cut = legs[np.ix_(chosen or (0,), rest)]
        total += int(np.isfinite(fronts).sum(axis=1) @ np.isfinite(cut).astype(np.int64) @ np.isfinite(backs).sum(axis=1))
        for u, back in enumerate(backs):
            better += int(np.searchsorted(back, (below - cut[:, u, None] - fronts).ravel(), side="left").sum())
    return total, better


def rank_in_all_orders(n: int, tm: np.ndarray, dm: np.ndarray, order: list, weights: tuple[float, float] = (0.1875, 0.075), base: float = 0.6625) -> tuple | None:
    """(n_orders, rank, best, mine) of one order of stops; None if one of its legs is missing (infinite).

    The score is ``base`` plus the weighted time and distance, each scaled to 1 for the least and 0 for the largest value
    over all orders (1 where they are equal); ``base`` is what all orders of a request have in common. Scores within half of 1e-9 count as equal, which is what rounding to 9 digits keeps apart.
    """
    legs = [np.asarray(values, float).reshape(n, n) for values in (tm, dm)]
    path = [sum(x[i, j] for i, j in zip(order, order[1:])) for x in legs]
    if not all(map(np.isfinite, path)):
        return None
    if n == 1:
        return 1, 1, base + sum(weights), base + sum(weights)
    whole = np.where(np.isfinite(legs[0]), 0.0, np.inf)
    short, mine = 0.0, 0.0
    for weight, x, value in zip(weights, legs, path):
        low, high = _subset_bounds(x, False), _subset_bounds(x, True)
        if high > low:
            whole = whole + weight * x / (high - low)
            short, mine = short + weight * low / (high - low), mine + weight * value / (high - low)
    orders, better = _halves(whole, mine - 5e-10)
    best = _subset_bounds(whole, False)
    top = base + sum(weights)
    return orders, 1 + better, top - (best - short), top - (mine - short)


def rank_in_listed_orders(n: int, tm: np.ndarray, dm: np.ndarray, order: np.ndarray, weights: tuple[float, float] = (0.1875, 0.075), base: float = 0.6625) -> list[tuple | None]:
    """``rank_in_all_orders`` for several requests of few stops: the sums of all orders are made at once, for a slice of requests.

    ``tm``, ``dm``: (requests, n * n) with infinity for missing legs; ``order``: (requests, n).
    """
    top, out = base + sum(weights), []
    path = [x[np.arange(len(x))[:, None], order[:, :-1] * n + order[:, 1:]].sum(axis=1) for x in (tm, dm)]
    step = max(1, LISTED // factorial(n - 1))
    for lo in range(0, len(tm), step):
        whole, mine, good = 0.0, 0.0, True
        for weight, x, value in zip(weights, (tm, dm), path):
            sums, value = _order_sums(x[lo:lo + step], n - 1, False), value[lo:lo + step]
            there = np.isfinite(sums)
            low, high = np.where(there, sums, np.inf).min(axis=1), np.where(there, sums, -np.inf).max(axis=1)
            share = np.where(high > low, weight / np.where(high > low, high - low, 1.0), 0.0)
            floor = np.where(np.isfinite(low), low, 0.0)
            whole = whole + share[:, None] * (np.where(there, sums, 0.0) - floor[:, None])
            mine = mine + share * (np.where(np.isfinite(value), value, np.inf) - floor)
            good = good & there
        fine = np.isfinite(path[0][lo:lo + step]) & np.isfinite(path[1][lo:lo + step])
        best = np.where(good, whole, np.inf).min(axis=1)
        better = (good & (whole < (mine - 5e-10)[:, None])).sum(axis=1)
        out += [(int(c), 1 + int(b), top - w, top - x) if ok else None for ok, c, b, w, x in zip(fine, good.sum(axis=1), better, best, mine)]
    return out


def rank_orders(req: DataFrame, order: str) -> DataFrame:
    """(req_id, n_orders, rank, top1, gap_pct): the place of each request's ``order`` among all orders of its stops.

    Any number of stops; up to nine places all orders are listed for many requests at once, beyond that time grows with the
    number of orders' halves and memory with those of one set of stops. Requests whose order has a missing leg are left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            sizes = batch.column("n").to_numpy()
            for n in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == n))
                legs = [np.nan_to_num(part.column(c).flatten().to_numpy(zero_copy_only=False).astype(float), nan=np.inf).reshape(-1, n * n) for c in ("tm", "dm")]
                order = part.column("ord").flatten().to_numpy().astype(np.int64).reshape(-1, n)
                found = rank_in_listed_orders(n, *legs, order) if factorial(n - 1) <= LISTED else (rank_in_all_orders(n, t, d, o.tolist()) for t, d, o in zip(*legs, order))
                for key, ranked in zip(part.column("req_id").to_pylist(), found):
                    if ranked:
                        orders, rank, best, mine = ranked
                        rows.append((key, orders, rank, best - mine <= 5e-10, round(max(0.0, (best - mine) / best) * 100, 4)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.float64()))], names=["req_id", "n_orders", "rank", "top1", "gap_pct"])

    # one long request may outweigh thousands of short ones: they are dealt over a given number of tasks, which adaptive execution leaves alone
    rows = req.select(F.col("req_id").cast("long").alias("req_id"), "n", "tm", "dm", F.col(order).alias("ord"))
    sc = req.sparkSession.sparkContext
    spread = rows.repartition(max(int(req.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * sc.defaultParallelism), F.xxhash64("req_id"))
    return spread.mapInArrow(run, "req_id long, n_orders long, rank long, top1 boolean, gap_pct double")
