from pyspark.sql import functions as F

import __spark_entry__ as E
from placelore.operators import graphq as G
from placelore.operators import questions as Q

ASKED = [(1, "Where can I go Surfing, surf or hike near Blue Bay?"), (2, "HIKE! hiking; a hike-up (surf)"), (3, None), (4, ""), (5, "uncrowded surfing in the North Coast"), (6, "nothing known"), (6, "nothing known")]
WORDS = [("activity", "surf", "Surfing"), ("activity", "surfing", "Surfing"), ("activity", "hike", "Hiking"), ("activity", "hike", "Trekking"), ("place", "blue bay", "Blue Bay"),
         ("location", "north coast", "North Coast"), ("trigger", "uncrowded", "uncrowded"), ("activity", "up", "Climbing"), ("activity", "  ", "Blank")]


def frames(spark):
    q = spark.createDataFrame(ASKED, "qid bigint, asked string")
    return q.select("qid", "asked", F.lit("x").alias("term")), spark.createDataFrame(WORDS, "kind string, word string, term string")


def test_terms_of_whole_questions(spark):
    q, d = frames(spark)
    rows = {(r.qid, r.kind, r.term, r.nth) for r in Q.match_terms(q, d, most=2).collect()}
    assert rows == {(1, "activity", "Surfing", 1), (1, "activity", "Hiking", 2), (1, "place", "Blue Bay", 1), (2, "activity", "Hiking", 1), (2, "activity", "Trekking", 2),
                    (5, "trigger", "uncrowded", 1), (5, "activity", "Surfing", 1), (5, "location", "North Coast", 1)}
    assert Q.match_terms(q.limit(0), d).count() == 0 and Q.match_terms(q, d.limit(0)).count() == 0


def test_many_words_take_the_join_and_find_the_same(spark):
    q, d = frames(spark)
    key = lambda df: sorted({(r.qid, r.word, r.pos) for r in df.collect()})
    words = d.select("word").distinct()
    assert key(Q.found_words(q, words, "qid", "asked")) == key(Q.found_words(q, words, "qid", "asked", max_words=3)) != []


def test_any_term_in_named_places_and_areas(spark):
    q, d = frames(spark)
    terms = Q.rewritten(Q.match_terms(q, d), spark.createDataFrame([("activity", "uncrowded", "Surfing", "Snorkelling")], "kind string, trigger string, term string, instead string"))
    has = spark.createDataFrame([("activity", 1, "Blue Bay", "Surfing", "positive", 9.0, "North Coast", "P", "c"), ("activity", 2, "Red Bay", "Surfing", "positive", 50.0, "South", "P", "c"),
                                 ("activity", 2, "Red Bay", "Hiking", None, 40.0, "South", "P", "c"), ("activity", 1, "Blue Bay", "Hiking up", "negative", 4.0, "North Coast", "P", "c"),
                                 ("activity", 3, "Reef", "Snorkelling tours", "neutral", 5.0, "North Coast", None, "c"), ("activity", 4, "Far Reef", "Snorkelling", "neutral", 6.0, "South", "north coast", "c"),
                                 ("feature", 4, "Far Reef", "Crowds", "negative", 30.0, "South", "north coast", "c")],
                                "kind string, place_id bigint, place_name string, term string, sentiment string, pct double, district string, province string, category string")
    asked = q.select("qid").distinct().withColumn("suggested", F.lit(5))
    got = sorted((r.qid, r.place_name, r.term, r["rank"]) for r in Q.ask_any(asked, terms, has, "activity").collect())
    assert got == [(1, "Blue Bay", "Surfing", 1), (2, "Blue Bay", "Surfing", 2), (2, "Red Bay", "Surfing", 1), (5, "Far Reef", "Snorkelling", 1), (5, "Reef", "Snorkelling tours", 2)]
    bad = Q.avoided_places(Q.match_terms(q, d), has, spark.createDataFrame([("uncrowded", "crowd", 20.0)], "trigger string, avoid string, min_pct double"))
    got = sorted((r.qid, r.place_name, r["rank"]) for r in Q.ask_any(asked, terms, has, "activity", avoided=bad).collect())
    assert got == [(1, "Blue Bay", 1), (2, "Blue Bay", 2), (2, "Red Bay", 1), (5, "Reef", 1)]


def test_stages_and_routes(spark):
    q = spark.createDataFrame([(i, "even" if i % 2 == 0 else "odd" if i < 7 else "none") for i in range(9)], "qid bigint, route string")
    seen = []

    def stage(keep):
        def run(left):
            seen.append(left.count())
            return left.filter(keep).select("qid", F.lit("p").alias("place_name"))
        return run

    got = {r.qid: r.stage for r in Q.first_answer(q, [("a", stage("qid < 3")), ("b", stage("qid < 6")), ("c", stage("qid = 8"))]).collect()}
    assert got == {**{i: "a" for i in range(3)}, **{i: "b" for i in range(3, 6)}, 8: "c"} and seen == [9, 6, 3]
    fact = lambda name, keep="true": lambda rows: rows.filter(keep).select("qid", F.lit("p").alias("place_name"), F.lit(name).alias("fact"))
    rows = {(r.qid, r.route, r.fact) for r in Q.dispatch(q, {"even": fact("e", "qid > 2"), "odd": fact("o")}, fact("general")).collect()}
    assert rows == {(0, "even", "general"), (2, "even", "general"), (4, "even", "e"), (6, "even", "e"), (8, "even", "e"), (1, "odd", "o"), (3, "odd", "o"), (5, "odd", "o"), (7, "none", "general")}


def test_nearest_with_many_places_on_one_spot(spark):
    """Equal to all pairs where spots hold many places, and a spot meets spots, not their places."""
    from placelore.functions.geo import haversine_km

    rows = [(i, 6.0 + (i * 37 % 9) / 3, 80.0 + (i * 53 % 7) / 4) for i in range(150)] + [(200, 9.9, 82.0)]
    p = spark.createDataFrame(rows, "place_id bigint, lat double, lon double")
    got = {(r.place_id, r["rank"], r.near_id) for r in G.nearest(p, p, 4).collect()}
    o = p.toDF("near_id", "nlat", "nlon")
    km = F.round(haversine_km(F.col("lat"), F.col("lon"), F.col("nlat"), F.col("nlon")), 6)
    pairs = p.join(o, F.col("place_id") != F.col("near_id")).select("place_id", "near_id", km.alias("km")).collect()
    want = set()
    for i, _, _ in rows:
        mine = sorted((r.km, r.near_id) for r in pairs if r.place_id == i)[:4]
        want |= {(i, k + 1, near) for k, (_, near) in enumerate(mine)}
    assert got == want


def test_what_to_avoid_is_kept_by_trigger(spark):
    """Places to avoid are listed once per trigger, however many questions hold it."""
    terms = spark.createDataFrame([(q, "trigger", "uncrowded") for q in range(50)] + [(q, "activity", "surf") for q in range(50)], "qid bigint, kind string, term string")
    has = spark.createDataFrame([("activity", p, f"P{p}", "surf", "positive", 50.0 - p, 9, "d", "p", "c") for p in range(20)]
                                + [("feature", p, f"P{p}", "crowds", "negative", 40.0, 9, "d", "p", "c") for p in range(5)],
                                "kind string, place_id bigint, place_name string, term string, sentiment string, pct double, review_count bigint, district string, province string, category string")
    avoided = Q.avoided_places(terms, has, spark.createDataFrame([("uncrowded", "crowd", 20.0)], "trigger string, avoid string, min_pct double"))
    assert avoided.bad.count() == 5
    q = spark.createDataFrame([(q, 3) for q in range(50)], "qid bigint, suggested int")
    got = sorted((r.qid, r["rank"], r.place_name) for r in Q.ask_any(q, terms, has, "activity", avoided=avoided, features=None).collect())
    assert got == [(i, k + 1, f"P{5 + k}") for i in range(50) for k in range(3)]


def test_dense_blocks_hold_few_scores():
    import tracemalloc

    import numpy as np
    import pandas as pd

    from placelore.operators.similarity import block_topk

    rng = np.random.default_rng(1)
    base, vectors = rng.normal(size=(4, 20_000)), rng.normal(size=(1024, 4))
    tracemalloc.start()
    got = block_topk(np.arange(20_000), base, np.arange(1024), pd.Series(list(vectors)), 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    s = vectors[:40] @ base
    s[np.arange(40), np.arange(40)] = -np.inf
    first = got.sort_values("score", ascending=False).drop_duplicates("qid").set_index("qid")["id"]
    assert [first[i] for i in range(40)] == s.argmax(axis=1).tolist()
    assert peak < 100e6  # 1,024 queries at once would hold 164 MB of scores, and as much again to sort them


def test_questions_that_ask_the_same_meet_places_once(spark):
    """every question met every edge of its terms before places were counted."""
    terms = [(q, "activity", "surf") for q in range(6)] + [(q, "facility", "Bar") for q in range(5)] + [(0, "activity", "swim"), (1, "location", "East"), (2, "location", "West"), (3, "place", "x")]
    has = [("activity", p, f"P{p}", t, "positive", 20.0, f"D{p % 3}", ["East", "West", None][p % 3]) for p in range(9) for t in (["Surfing", "surf school"] if p % 2 else ["Swim"])]
    has += [("facility", p, f"P{p}", "Beach bar", "negative" if p == 5 else "positive", 5.0, f"D{p % 3}", ["East", "West", None][p % 3]) for p in range(1, 8)]
    t = spark.createDataFrame(terms, "qid bigint, kind string, term string")
    h = spark.createDataFrame(has, "kind string, place_id bigint, place_name string, term string, sentiment string, pct double, district string, province string")
    kinds = {"activity": F.col("pct") >= 15, "facility": F.col("sentiment") != "negative"}
    out = Q.meet_all(t, h, kinds)
    want = set()
    for q in range(5):
        mine = lambda k: [w.lower() for i, kind, w in terms if i == q and kind == k]  # noqa: E731, B023
        meets = lambda k, ok: {e[1] for e in has if e[0] == k and ok(e) and any(w in e[3].lower() for w in mine(k))}  # noqa: E731, B023
        for p in meets("activity", lambda e: e[5] >= 15) & meets("facility", lambda e: e[4] != "negative"):
            if not mine("location") or ["east", "west", ""][p % 3] in mine("location"):
                want.add((q, p, f"P{p}"))
    got = [tuple(r) for r in out.select("qid", "place_id", "place_name").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [x for x in plan if "Aggregate [" in x and "place_id" in x and "qid" in x]


def _doubled(tmp_path):
    """The smallest tables with suppliers and their lines twice, so that each name is that of two places."""
    import os

    import duckdb

    con, source = duckdb.connect(), "/root/testdata/sf0.001"
    shift = {"supplier": "s_suppkey + {i} as s_suppkey", "lineitem": "l_suppkey + {i} as l_suppkey, l_orderkey + {i} as l_orderkey", "orders": "o_orderkey + {i} as o_orderkey"}
    for name in os.listdir(source):
        table = name.removesuffix(".parquet")
        con.execute(f"create view {table} as select * from '{source}/{name}'")
        if table in shift:
            twice = " union all ".join(f"select * replace ({shift[table].format(i=i)}) from {table}" for i in (0, 1_000_000))
            con.execute(f"create or replace view twice as {twice}")
            con.execute(f"copy (select * from twice) to '{tmp_path}/{name}' (format parquet)")
            con.execute(f"create or replace view {table} as select * from '{tmp_path}/{name}'")
        else:
            os.symlink(f"{source}/{name}", tmp_path / name)
    return con


def _same_as_sql(spark, con, path, name):
    cur = con.execute(E.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(str(dict(zip(names, r))[c]) for c in sorted(names)) for r in cur.fetchall())
    df = E.queries()[name](spark, str(path))
    assert sorted(tuple(str(r[c]) for c in sorted(names)) for r in df.collect()) == want
    return len(want)


def test_chain_of_names_with_several_places(spark, tmp_path):
    con = _doubled(tmp_path)
    assert _same_as_sql(spark, con, tmp_path, "q10_nearby_chain")


def test_chain_ranks_places_per_name_not_per_question(spark, monkeypatch):
    from placelore.plans import q_questions

    plans = []

    def first_answer(questions, stages, key="qid"):
        plans.extend(stage(questions)._jdf.queryExecution().optimizedPlan().toString() for _, stage in stages)
        return questions

    monkeypatch.setattr(q_questions.Q, "first_answer", first_answer)
    E.queries()["q10_nearby_chain"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 3 and not any("windowspecdefinition(qid" in p for p in plans)  # every question brought all its places to a ranking


def test_nearest_within_groups(spark):
    places = [(i, 6 + i * 37 % 50 / 10, 80 + i * 53 % 40 / 10) for i in range(60)]
    member = [(g, i) for g, m in (("a", 1), ("b", 7), ("c", 29)) for i in range(0, 60, m)] + [("d", 5)]
    spot = spark.createDataFrame(places, "place_id long, lat double, lon double")
    group = spark.createDataFrame(member, "g string, place_id long").join(spot, "place_id")
    anchors = spot.crossJoin(spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "g string"))
    got = G.nearest(anchors, group, 3, by="g").collect()
    for g in "abcde":
        ids = [i for x, i in member if x == g]
        alone = G.nearest(spot, spot.filter(F.col("place_id").isin(ids)), 3).collect() if ids else []
        assert {(r.place_id, r.near_id, r.rank) for r in got if r.g == g} == {(r.place_id, r.near_id, r.rank) for r in alone}


def test_one_key_is_dealt_to_every_task(spark):
    from placelore.session import meet

    rows = spark.range(400).select(F.col("id").alias("qid"), F.lit("asia").alias("location"))
    others = spark.createDataFrame([("asia", i) for i in range(30)] + [("africa", 99)], "location string, place_id long")
    for most in (100, 10):  # broadcast, and copied to parts
        met = meet(rows, others, ["location"], most=most)
        parts = met.groupBy(F.spark_partition_id()).count().count()
        assert parts > 1 and met.count() == met.distinct().count() == 400 * 30 and "99" not in {str(r.place_id) for r in met.select("place_id").distinct().collect()}


def test_questions_come_last_in_multi_criteria(spark):
    plan = E.queries()["q9_multi_criteria"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    first = next(line for line in plan.splitlines() if "Join" in line)
    assert "sid" in first and "place_id" not in first  # the answers of all questions were joined to the features by place
