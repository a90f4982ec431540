import json

from pyspark.sql import functions as F

from placelore.functions import normalize as N
from placelore.operators import profiles as PR
from placelore.sources import files, sinks
from placelore.streaming import review_stream as RS


def test_read_reviews(spark, tmp_path):
    (tmp_path / "ella.json").write_text(json.dumps([{"title": "t", "body": "b", "rating": 5, "place_name": "Ella Rock!"}, {"title": "x", "body": "y"}]))
    (tmp_path / "empty.json").write_text("[]")
    (tmp_path / "_meta.json").write_text(json.dumps([{"title": "no"}]))
    rows = files.read_reviews(spark, str(tmp_path), files.REVIEW_A).orderBy("title").collect()
    assert [(r.title, r.place_key) for r in rows] == [("t", "Ella_Rock"), ("x", "ella")]


def test_read_pois_defaults(spark, tmp_path):
    (tmp_path / "p.csv").write_text("poi_id,name,cost,duration_time_min,latitude\n1,A,bad,,6.9\n2, ,1,2,3\n3,C,12.5,30,x\n")
    rows = files.read_pois(spark, str(tmp_path / "p.csv")).orderBy("poi_id").collect()
    assert [(r.name, r.cost, r.duration_time_min, r.latitude) for r in rows] == [("A", 0.0, 60.0, 6.9), ("C", 12.5, 30.0, None)]


def test_encyclopedia_skips_broken_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"poi_name": "Baker's Falls", "latitude": "6.8"}))
    (tmp_path / "b.json").write_text("{broken")
    assert [r.key for r in files.read_encyclopedia(spark, str(tmp_path)).collect()] == ["bakersfalls"]


def test_write_by_place_and_triples(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "place_key string, x int")
    sinks.write_by_place(df, str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).groupBy("place_key").count().orderBy("place_key").collect()[0]["count"] == 2
    hot = spark.range(1000).selectExpr("case when id < 900 then 'hot' when id < 950 then null else cast(id as string) end as place_key", "id as x", "map('a', id) as m")
    sinks.write_by_place(hot, str(tmp_path / "hot"), rows_per_file=100)
    assert len(list((tmp_path / "hot" / "place_key=hot").glob("*.json"))) >= 9
    assert sorted(r.x for r in spark.read.json(str(tmp_path / "hot")).collect()) == list(range(1000))
    sinks.write_triples(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t" / "parquet")).count() == 3


def rows_of(df):
    return sorted(str(sorted(r.asDict().items())) for r in df.collect())


REVIEW = "review_id string, place_key string, url string, ts timestamp, text string"
TEXTS = ["Avoid weekends. Very crowded.", "Early morning is best. Entry fee is Rs. 500.", "Quiet in the evening.", "Entry fee is Rs. 900. Crowded in July.", None]


def some_reviews(spark, names, day):
    rows = [(n, f"p{i % 3}", n, f"2024-01-{day:02d} 0{i % 10}:00:00", TEXTS[i % len(TEXTS)]) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "review_id string, place_key string, url string, ts string, text string").withColumn("ts", F.to_timestamp("ts")).coalesce(1)


def test_stream_profiles_equal_batch_over_growing_files(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))

    def run():
        stream = RS.clean_stream(spark.readStream.schema(REVIEW).option("maxFilesPerTrigger", 1).parquet(src))
        RS.profile_stream(stream, out, ck, every=3).awaitTermination()

    def check():
        norm = N.normalized(spark.read.schema(REVIEW).parquet(src))
        assert rows_of(RS.current_profiles(spark, out)) == rows_of(PR.profiles(norm, "place_key"))
        assert rows_of(RS.total_ballots(spark, out, every=3)) == rows_of(PR.ballots(norm, "place_key"))

    for k in range(3):
        some_reviews(spark, [f"a{k}{i}" for i in range(4 + k)], 1 + k).write.mode("append").parquet(src)
    run()
    check()
    for k in range(4):
        some_reviews(spark, [f"b{k}{i}" for i in range(3)], 9 - k).write.mode("append").parquet(src)
    run()
    check()
    run()  # nothing new: nothing counted twice
    check()


def test_batch_run_again_gives_the_same(spark, tmp_path):
    out = str(tmp_path / "out")
    parts = [N.normalized(some_reviews(spark, [f"c{k}{i}" for i in range(5)], 1 + k)) for k in range(5)]
    for k, part in enumerate(parts):
        RS.fold_batch(part, k, out, every=2)
        if k in (1, 2, 4):
            RS.fold_batch(part, k, out, every=2)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    assert rows_of(RS.current_profiles(spark, out)) == rows_of(PR.profiles(whole, "place_key"))
    RS.fold_batch(parts[0].limit(0), 5, out, every=2)  # a batch without rows keeps all profiles
    assert rows_of(RS.current_profiles(spark, out)) == rows_of(PR.profiles(whole, "place_key"))


def test_stream_takes_repeats_once_and_leaves_late_rows_out(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))

    def run():
        stream = RS.clean_stream(spark.readStream.schema(REVIEW).parquet(src), "2 days")
        RS.profile_stream(stream, out, ck).awaitTermination()

    first, repeats, late = some_reviews(spark, ["a", "b", "c", "d"], 10), some_reviews(spark, ["a", "b", "e"], 11), some_reviews(spark, ["f", "g", "h"], 1)
    first.write.parquet(src)
    run()
    repeats.write.mode("append").parquet(src)
    run()
    late.write.mode("append").parquet(src)
    run()
    taken = first.unionByName(repeats.filter("url = 'e'"))
    assert rows_of(RS.current_profiles(spark, out)) == rows_of(PR.profiles(N.normalized(taken), "place_key"))
    stored = spark.createDataFrame([("p0", 1), ("p9", 2)], "place_key string, v int")
    fresh = spark.createDataFrame([("p0", 7)], "place_key string, v int")
    assert {(r.place_key, r.v) for r in RS.upsert_profiles(stored, fresh).collect()} == {("p0", 7), ("p9", 2)}


def test_upper_median(spark):
    df = spark.createDataFrame([("a", x) for x in (5, 1, 9, 7)] + [("b", 3)], "k string, x int")
    assert {r.k: r.median for r in PR.upper_median(df, ["k"], "x").collect()} == {"a": 7, "b": 3}
    assert df.agg(F.count("*")).first()[0] == 5
