import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from placelore.operators import trips as P

M = P.MICRO


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(5)
    n = 12
    places = [(i, 30 + rng.randrange(90), float(rng.randrange(0, 3000, 100)), rng.randrange(0, 50) / 10) for i in range(n)]
    edges = {(a, b): float(rng.randrange(10, 200)) for a in range(n) for b in range(n) if a != b and rng.random() < 0.75}
    reqs = {r: rng.sample(range(n), rng.randrange(1, 7)) for r in range(25)}
    pl = spark.createDataFrame(places, "place_id bigint, duration_min int, cost double, satisfaction double")
    ed = spark.createDataFrame([(a, b, w * 0.7, w) for (a, b), w in edges.items()], "a bigint, b bigint, distance_km double, travel_time_min double")
    st = spark.createDataFrame([(r, s, i + 1) for r, ss in reqs.items() for i, s in enumerate(ss)], "req_id bigint, place_id bigint, pos int")
    both = dict(edges)
    for (a, b), w in edges.items():
        both.setdefault((b, a), w)
    req = P.requests(st.withColumn("budget", F.lit(500 * M).cast("bigint")), pl, P.two_way(ed), ["budget"]).cache()
    return {"req": req, "reqs": reqs, "edges": both, "dur": {p[0]: p[1] for p in places}, "sat": {p[0]: p[3] for p in places}, "roads": P.two_way(ed), "spark": spark}


def time_of(w, route):
    t = sum(w["dur"][p] for p in route)
    for a, b in zip(route, route[1:]):
        if (a, b) not in w["edges"]:
            return None
        t += w["edges"][a, b]
    return t


def nn(w, start, rest):
    route, rest = [start], list(rest)
    while rest:
        best = min(rest, key=lambda x: (w["edges"].get((route[-1], x), 1e9), rest.index(x)))
        route.append(best)
        rest.remove(best)
    return route


def test_nearest_neighbour(world):
    got = {r.req_id: r.ord for r in world["req"].select("req_id", P.nearest_order(P._upto(F.col("n"))).alias("ord")).collect()}
    for r, stops in world["reqs"].items():
        want = nn(world, stops[0], stops[1:])
        if time_of(world, want) is not None:
            assert [stops[i] for i in got[r]] == want


def test_best_order_is_the_exhaustive_one(world):
    got = {r.req_id: r for r in P.best_orders(world["req"], 7).collect()}
    for r, stops in world["reqs"].items():
        times = [t for t in (time_of(world, [stops[0], *o]) for o in itertools.permutations(stops[1:])) if t is not None]
        if times:
            assert got[r].n_feasible == len(times) and got[r].total_time == round(min(times) * M)
            assert time_of(world, [stops[i] for i in got[r].ord]) == pytest.approx(min(times))
        else:
            assert r not in got


def test_two_opt_matches_the_loop(world):
    def cost(route):
        return sum(world["edges"].get(p, 1e9) for p in zip(route, route[1:]))

    got = {r.req_id: r.ord for r in world["req"].select("req_id", P.two_opt(F.sequence(F.lit(0), F.col("n") - 1)).alias("ord")).collect()}
    for r, stops in world["reqs"].items():
        best, better = list(stops), len(stops) >= 4
        for _ in range(20):
            if not better:
                break
            better = False
            for i in range(1, len(best) - 2):
                for j in range(i + 1, len(best) - 1):
                    cand = best[:i] + best[i:j + 1][::-1] + best[j + 1:]
                    if not better and cost(cand) + 1e-9 < cost(best):
                        best, better = cand, True
        assert [stops[i] for i in got[r]] == best


def test_subsets_fit_and_are_maximal(world):
    rows = P.subset_options(world["req"]).collect()
    for row in rows:
        stops = world["reqs"][row.req_id]
        chosen = [stops[i] for i in row.chosen]
        t = time_of(world, nn(world, stops[0], chosen))
        assert t is not None and t <= 500
        for p in stops[1:]:
            if p not in chosen:
                more = time_of(world, nn(world, stops[0], chosen + [p]))
                assert more is None or more > 500
    assert {r.req_id for r in rows if r.fitted_all} == {
        r for r, s in world["reqs"].items() if len(s) > 1 and (time_of(world, nn(world, s[0], s[1:])) or 1e9) <= 500}


def test_a_trial_of_a_set_makes_its_order_once(world):
    """The order is bound before its legs are summed, and long visits or a missing leg do not fit."""
    fit = world["req"].select("req_id", "n", P.fits(P._upto(F.col("n")), F.lit(500 * M)).alias("fit"))
    assert fit._jdf.queryExecution().analyzed().toString().count("array_except") <= 2  # as often as one order names it
    for row in fit.collect():
        s = world["reqs"][row.req_id]
        assert row.fit == (row.n > 1 and (time_of(world, nn(world, s[0], s[1:])) or 1e9) <= 500)


def test_day_split_covers_every_stop_once(world):
    d = world["req"].select("req_id", P.day_split(F.sequence(F.lit(0), F.col("n") - 1), F.lit(3), F.lit(4)).alias("d")).collect()
    for row in d:
        assert [p for day in row.d for p in day.places] == world["reqs"][row.req_id]
        assert len(row.d) <= 3


def test_shortest_paths_match_relaxation(world):
    spark = world["spark"]
    got = {(r.source, r.node): r.total for r in P.shortest_paths(spark.createDataFrame([(0,), (3,)], "source bigint"), world["roads"]).collect()}
    for s in (0, 3):
        dist = {s: 0.0}
        for _ in range(12):
            for (a, b), w in world["edges"].items():
                if a in dist and dist[a] + w < dist.get(b, 1e18):
                    dist[b] = dist[a] + w
        assert {n: d for (src, n), d in got.items() if src == s} == pytest.approx(dist)


def test_shortest_routes_list_their_stops(world):
    spark = world["spark"]
    ways = P.shortest_paths(spark.createDataFrame([(0,), (3,), (3,), (99,)], "source bigint"), world["roads"])
    rows = P.shortest_routes(ways).collect()
    assert {(r.source, r.node) for r in rows if r.source == r.node} == {(0, 0), (3, 3), (99, 99)} and len(rows) == len({(r.source, r.node) for r in rows})
    for r in rows:
        assert r.path[0] == r.source and r.path[-1] == r.node and len(set(r.path)) == len(r.path)
        assert sum(world["edges"][a, b] for a, b in zip(r.path, r.path[1:])) == pytest.approx(r.total)
    # equally short ways: the smaller node before wins, also when it is found later
    tie = spark.createDataFrame([(1, 5, 1.0), (5, 9, 3.0), (1, 7, 2.0), (7, 2, 1.0), (2, 9, 1.0), (9, 4, 1.0)], "a bigint, b bigint, travel_time_min double")
    got = {r.node: r.path for r in P.shortest_routes(P.shortest_paths(spark.createDataFrame([(1,)], "source bigint"), tie)).collect()}
    assert got[4] == [1, 7, 2, 9, 4]
    assert P.shortest_routes(P.shortest_paths(spark.createDataFrame([], "source bigint"), tie)).count() == 0


def test_rank_among_all_orders_at_any_length(world, spark):
    """Subset programming and halves against the list of all orders, with missing legs and ties."""
    rng = random.Random(9)
    rows = []
    for r in range(14):
        n = 1 + r % 8
        cell = lambda i, j: None if i == j or rng.random() < 0.08 else rng.randrange(1, 30 if r % 3 else 3) * M  # noqa: E731,B023
        tm = [cell(i, j) for i in range(n) for j in range(n)]
        dm = [None if t is None else rng.randrange(1, 40) * M for t in tm]
        rows.append((r, n, tm, dm, [0, *rng.sample(range(1, n), n - 1)], "clash"))
    df = spark.createDataFrame(rows, "req_id bigint, n int, tm array<bigint>, dm array<bigint>, ord array<int>, rank string")
    want = {}
    for r, n, tm, dm, mine, _ in rows:
        orders = {}
        for rest in itertools.permutations(range(1, n)):
            p = (0, *rest)
            legs = [(tm[a * n + b], dm[a * n + b]) for a, b in zip(p, p[1:])]
            if all(t is not None for t, _ in legs):
                orders[p] = (sum(t for t, _ in legs), sum(d for _, d in legs))
        if tuple(mine) not in orders:
            continue
        scaled = lambda x, k: 1.0 if min(o[k] for o in orders.values()) == max(o[k] for o in orders.values()) else 1 - (x[k] - min(o[k] for o in orders.values())) / (max(o[k] for o in orders.values()) - min(o[k] for o in orders.values()))  # noqa: E731,B023
        score = {p: round(0.75 * (0.55 + 0.25 * scaled(x, 0) + 0.10 * scaled(x, 1)) + 0.25, 9) for p, x in orders.items()}
        me, best = score[tuple(mine)], max(score.values())
        want[r] = (len(orders), 1 + sum(s > me for s in score.values()), best == me, round(max(0, (best - me) / best) * 100, 4))
    got = {x.req_id: (x.n_orders, x["rank"], x.top1, x.gap_pct) for x in P.rank_orders(df, "ord").collect()}
    assert got == want and len(want) > 5
    assert P.rank_orders(df.limit(0), "ord").count() == 0


def test_orders_listed_at_once_rank_like_halves():
    """A slice of requests of one length against one request at a time, at lengths on both sides of the listed ones."""
    rng = np.random.default_rng(3)
    for n, count in ((1, 3), (2, 3), (5, 40), (8, 6), (10, 2)):
        tm = np.where(rng.random((count, n * n)) < 0.06, np.inf, rng.integers(1, 40, (count, n * n)) * float(M))
        dm = np.where(np.isfinite(tm), rng.integers(1, 60, (count, n * n)) * float(M), np.inf)
        order = np.array([[0, *(1 + rng.permutation(n - 1))] for _ in range(count)])
        got = P.rank_in_listed_orders(n, tm, dm, order)
        want = [P.rank_in_all_orders(n, t, d, o.tolist()) for t, d, o in zip(tm, dm, order)]
        assert [x and x[:2] for x in got] == [x and x[:2] for x in want]
        assert [x[2:] for x in got if x] == [pytest.approx(x[2:]) for x in want if x]


def test_pareto_front_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(r, i, float(rng.randrange(6)), float(rng.randrange(6)), rng.randrange(6), rng.randrange(6) / 5) for r in range(3) for i in range(90)]
    df = spark.createDataFrame(rows, "req_id int, route_key int, total_satisfaction double, total_cost double, total_time int, similarity double")

    def beats(a, b):
        x, y = (a[2], -a[3], -a[4], a[5]), (b[2], -b[3], -b[4], b[5])
        return all(p >= q for p, q in zip(x, y)) and x != y

    want = {(a[0], a[1]) for a in rows if not any(beats(b, a) for b in rows if b[0] == a[0])}
    for chunk in (8, 64):
        assert {(r.req_id, r.route_key) for r in P.pareto_front(df, chunk=chunk).collect()} == want


def test_history_similarity_matches_pairs(spark):
    rng = random.Random(2)
    trips = {i: rng.sample(range(15), rng.randrange(1, 14)) for i in range(40)}
    sets = [sorted(rng.sample(range(18), rng.randrange(1, 13))) for _ in range(30)]
    t = spark.createDataFrame([(i, p) for i, ps in trips.items() for p in ps], "trip_id int, place_id bigint")
    s = spark.createDataFrame([(x,) for x in sets], "set array<bigint>").distinct()
    for r in P.history_similarity(s, *P.history_index(t, max_len=6)).collect():
        want = max(len(set(r.set) & set(ps)) / len(set(r.set) | set(ps)) for ps in trips.values())
        assert r.similarity == pytest.approx(want)


@pytest.mark.parametrize("busy", [1, 3, 256])
def test_history_similarity_of_prefixes_and_busy_pairs(spark, busy):
    rng = random.Random(3)
    trips = {i: rng.sample(range(20), rng.randrange(1, 12)) for i in range(60)}
    paths = {i: rng.sample(range(24), rng.randrange(1, 10)) for i in range(40)}
    t = spark.createDataFrame([(i, p) for i, ps in trips.items() for p in ps], "trip_id int, place_id bigint")
    p = spark.createDataFrame(list(paths.items()), "id int, path array<bigint>")
    past, heavy, max_len = P.history_index(t, max_len=6, busy=busy)
    assert (heavy is None) == (busy == 256)
    got = {r.id: r.best for r in P.path_similarity(p, "id", lambda n: F.sequence(F.lit(1), n), past, heavy, max_len).collect()}
    for i, path in paths.items():
        want = [max(len(set(path[:k]) & set(ps)) / len(set(path[:k]) | set(ps)) for ps in trips.values()) for k in range(1, len(path) + 1)]
        assert got.get(i, [0.0] * len(path)) == pytest.approx(want)


def test_a_pool_stays_in_its_row(world):
    """The pool of routes is made, scored and ranked without a shuffle, and equals the work on one row per route."""
    trips = world["spark"].createDataFrame([(i, p, k) for i in range(9) for k, p in enumerate(range(i % 4, 12, 3))], "trip_id int, place_id bigint, pos int")
    pools = P.route_pool(world["req"], trips).cache()
    rows = pools.select("req_id", F.inline("routes"))
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert exchanges(P.rank_pool(pools)) == exchanges(pools)
    key = lambda r: (r.req_id, r["rank"], r.route_key, r.in_front, round(r.preference_score, 9))
    cols = ["req_id", "rank", "route_key", "in_front", "preference_score"]
    got, want = [sorted(map(key, df.select(cols).collect())) for df in (P.rank_pool(pools), P.rank_routes(rows))]
    assert got == want and len(want) > 20
    assert rows.groupBy("req_id", "route_key").count().filter("count > 1").isEmpty()


def test_walks_are_feasible_and_repeatable(world):
    a = sorted(map(str, P.sampled_walks(world["req"], 4, 2).collect()))
    assert a == sorted(map(str, P.sampled_walks(world["req"], 4, 2).collect()))
    for r in P.sampled_walks(world["req"], 4, 2).collect():
        stops = world["reqs"][r.req_id]
        assert sorted(r.ord) == list(range(len(stops)))
        assert time_of(world, [stops[i] for i in r.ord]) <= 500


def test_long_requests_and_unknown_starts(spark):
    n = 102
    places = spark.createDataFrame([(i, 10, 1.0, 1.0) for i in range(n)], "place_id bigint, duration_min int, cost double, satisfaction double")
    roads = spark.createDataFrame([(a, b, 1.0, float(1 + abs(a - b))) for a in range(n) for b in range(n) if a != b], "a bigint, b bigint, distance_km double, travel_time_min double")
    sizes = {1: 9, 2: 10, 3: 12, 4: 101}
    stops = [(r, i, i + 1) for r, k in sizes.items() for i in range(k)] + [(5, 999, 1), (5, 1, 2), (5, 2, 3), (6, 3, 1), (6, 999, 2), (6, 4, 3)]
    st = spark.createDataFrame(stops, "req_id bigint, place_id bigint, pos int")
    req = P.requests(st, places, roads)
    got = {r.req_id: r for r in P.best_orders(req).collect()}
    assert {r: got[r].method for r in got} == {1: "exact", 2: "greedy", 3: "greedy", 4: "greedy", 6: "exact"}
    assert got[1].n_feasible == 40320 and all(got[r].ord == list(range(k)) for r, k in sizes.items())
    assert [tuple(r) for r in P.unknown_starts(st, places).collect()] == [(5, "unknown start")]
    keys = req.filter("req_id = 4").select(P.route_key(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")).first().k
    assert keys.endswith("98>99>100") and keys.startswith("00>01>")


def test_past_trip_weights_on_all_edges_and_one_way(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (2, 3)], "a bigint, b bigint")
    trips = spark.createDataFrame([(1, p, i) for i, p in enumerate([1, 2, 3, 4])] + [(2, p, i) for i, p in enumerate([4, 3, 1])], "trip_id bigint, place_id bigint, pos int")
    weights, report = P.past_trip_weights(trips, edges)
    assert {(r.a, r.b): r.pheromone for r in weights.collect()} == {(1, 2): 6.0, (2, 1): 1.0, (2, 3): 6.0, (3, 4): 11.0}  # 4 to 3 counts for its reverse
    assert [tuple(r) for r in report.collect()] == [(4, 1)]


def test_past_trip_queries_use_every_edge(spark):
    from placelore.plans import q_trips
    from types import SimpleNamespace

    edges = spark.createDataFrame([(a, b) for a in range(6) for b in range(6) if a != b], "a bigint, b bigint")
    trips = spark.createDataFrame([(1, p, p) for p in range(6)], "trip_id bigint, place_id bigint, pos int")
    v = SimpleNamespace(edges=edges, trips=trips)
    got = {(r.a, r.b): r.pheromone for r in q_trips.j16(v).collect()}
    assert got == {(a, b): 6.0 if b == a + 1 else 1.0 for a in range(6) for b in range(6) if a != b}
    assert [tuple(r) for r in q_trips.j16b(v).collect()] == [(5, 0)]


def test_nine_places_are_ranked_among_all_orders(spark):
    from placelore.plans import q_trips
    from types import SimpleNamespace

    rng = random.Random(3)
    n = 10
    pl = spark.createDataFrame([(i, 30, 0.0, 1.0) for i in range(n)], "place_id bigint, duration_min int, cost double, satisfaction double")
    edges = {(a, b): float(rng.randrange(10, 200)) for a in range(n) for b in range(n) if a != b}
    ed = spark.createDataFrame([(a, b, w * 0.7, w) for (a, b), w in edges.items()], "a bigint, b bigint, distance_km double, travel_time_min double")
    st = spark.createDataFrame([(r, p, p + 1) for r in (9, 10) for p in range(r)], "req_id bigint, place_id bigint, pos int")
    got = {r.req_id: r for r in q_trips.w6(SimpleNamespace(requests=P.requests(st, pl, P.two_way(ed)))).collect()}
    times = [sum(edges[x] for x in zip((0, *o), o)) for o in itertools.permutations(range(1, 9))]
    route = nn({"edges": edges}, 0, range(1, 9))
    mine = sum(edges[x] for x in zip(route, route[1:]))
    # distance is 0.7 of the time here, so orders rank by their time
    assert got[9].method == "exact" and got[9].n_orders == 40320 and got[9].rank == 1 + sum(t < mine - 1e-6 for t in times)
    assert got[9].top1 == (mine <= min(times)) and got[9].gap_pct >= 0
    assert got[10].method == "greedy" and got[10].rank is None
