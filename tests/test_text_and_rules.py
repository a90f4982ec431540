"""Literal rows: sentence to expected value."""

import html
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from placelore.functions import normalize as N
from placelore.functions import sentiment as S
from placelore.functions import text as T
from placelore.operators import extraction as X
from placelore.operators import language as L


def one(spark, expr, **row):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize("raw, want", [
    ("Café &amp; bar!!!  see http://x.y/z now \U0001F600", "Café & bar! see now"),
    ("a\r\n\r\n\r\n\r\nb \t c", "a\n\nb c"),
    (None, ""),
    ("wow?!?!", "wow!"),
])
def test_clean_text(spark, raw, want):
    assert one(spark, T.clean_text(F.col("t")), t=raw) == want


def test_html_and_nfkd_match_the_standard_library(spark):
    raw = "&eacute; &#233; &copy 2020 ﬁ ½"
    assert one(spark, T.nfkd(T.decode_entities(F.col("t"))), t=raw) == unicodedata.normalize("NFKD", html.unescape(raw))


@pytest.mark.parametrize("raw, want", [("  Ella's Rock! ", "Ella_s_Rock"), ("!!!", "unknown"), (None, "unknown")])
def test_safe_key(spark, raw, want):
    assert one(spark, T.safe_key(F.col("t")), t=raw) == want


def test_sentences_and_tokens(spark):
    assert one(spark, T.sentences(F.col("t")), t="One. Two!  Three? four") == ["One.", "Two!", "Three?", "four"]
    assert one(spark, T.tokens(F.col("t"), ["the", "no", "is"]), t="The sun is not up at 6 am, no") == ["sun", "not", "up", "at", "am", "no"]
    assert one(spark, T.bigrams(T.tokens(F.col("t"), [])), t="red blue green") == ["red blue", "blue green"]


@pytest.mark.parametrize("text, want", [
    ("early morning or evening", "EARLY_MORNING"), ("do not go in the afternoon", "EVENING"),
    ("never visit at noon, the sun is hot", "EARLY_MORNING"), ("late afternoon for the sunset", "EVENING"),
    ("not suitable in the evening", "EVENING"), ("not in the evening", "EARLY_MORNING"), ("avoid the morning", None), ("nothing here", None),
])
def test_time_of_day(spark, text, want):
    assert one(spark, N.time_of_day(F.col("t")), t=text) == want


@pytest.mark.parametrize("text, day, avoid", [
    ("avoid weekends", "WEEKDAY", ["WEEKEND"]), ("busy at the weekend", "WEEKEND", []), ("skip weekdays", "WEEKEND", ["WEEKDAY"]),
    ("poya day is special", "PUBLIC_HOLIDAY", []), ("avoid poya and weekends", "WEEKDAY", ["PUBLIC_HOLIDAY", "WEEKEND"]),
])
def test_days(spark, text, day, avoid):
    assert one(spark, N.recommended_day(F.col("t")), t=text) == day
    assert one(spark, N.avoided_days(F.col("t")), t=text) == avoid


@pytest.mark.parametrize("text, want", [
    ("not overly crowded", 2), ("very crowded", 5), ("busy place", 4), ("not too crowded", 2), ("manageable", 3), ("nobody was there", 1), ("fine", None),
])
def test_crowd(spark, text, want):
    assert one(spark, N.crowd_level(F.col("t")), t=text) == want


@pytest.mark.parametrize("text, want", [
    ("200 rupees for locals and 16000 rupees for foreigners", 16000), ("rs. 1,500", 1500), ("$ 10", 3000), ("us$ 2.5", 750), ("25 usd each", 7500),
    ("local price 100 rs, then much later on in the text another price is 900 rs", 900), ("free", None),
])
def test_amount(spark, text, want):
    assert one(spark, N.amount_lkr(F.col("t")), t=text) == want


@pytest.mark.parametrize("text, want", [("not expensive", "HIGH"), ("free entry", "FREE"), ("overpriced", "VERY_HIGH"), ("cheap", "LOW"), ("affordable", "MODERATE")])
def test_opinion(spark, text, want):
    assert one(spark, N.opinion_level(F.col("t")), t=text) == want


def test_season_and_months(spark):
    assert one(spark, N.season(F.col("t")), t="north-east monsoon") == "DRY_SEASON"
    assert one(spark, N.months(F.col("t")), t="from july to may") == ["MAY", "JULY"]


def test_sentiment_and_rules(spark):
    p = one(spark, S.points(F.col("t")), t="Not a bad place, great views but too crowded")
    assert (p.pos, p.neg) == (2, 3)

    def names(t):
        df = spark.createDataFrame([("r", "Here", t)], "review_id string, place_name string, text string")
        return {r.object for r in X.extract(df).collect()}

    assert names("The jeep safari was amazing") == {"Jeep safari"}
    assert names("We went scuba diving") == {"Scuba diving"}
    assert "Museum visit" in names("We saw the museum")
    assert names("workshop only") == set()


def test_triples_confidence(spark):
    df = spark.createDataFrame([("r1", "Old Fort", "The sunset was great. We walked around. The sunset was great.")], "review_id string, place_name string, text string")
    rows = {(r.object, r.sentiment, r.conf_c, r.explicit) for r in X.extract(df).collect()}
    assert ("Sunset watching", "positive", 86, True) in rows
    assert ("Fort visit", "neutral", 73, False) in rows
    assert len(rows) == 2


def test_language(spark):
    rows = spark.createDataFrame([("short",), ("the sun was in the sky and it is very big",), ("das ist nicht der gute Weg und es ist sehr schlecht",), ("xxxx yyyy zzzz qqqq wwww",)], "text string")
    assert [r.lang_detected for r in L.detect(rows).collect()] == ["en", "en", "de", "unknown"]


def test_emoji_class_matches_python():
    assert re.sub("\U0001F600", "", "a\U0001F600") == "a"


def test_fuzzy_match_is_exact_for_any_cutoff(spark):
    import random

    from placelore.operators import graphq as G

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 12)))
    names = sorted({word() for _ in range(60)})
    terms = sorted({word() for _ in range(25)} | {"abcd", "xyz"})
    tdf, ndf = spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(n,) for n in names], "name string")
    for cutoff in (0.2, 0.4, 0.65, 0.9, 1.0):
        want = {}
        for t in terms:
            ok = sorted((-(1 - distance(t, n) / max(len(t), len(n))), n) for n in names)
            if -ok[0][0] >= cutoff:
                want[t] = ok[0][1]
        assert {r.term: r.name for r in G.fuzzy_match(tdf, ndf, cutoff).collect()} == want


def test_merge_leaves_names_without_a_key_apart(spark):
    from placelore.operators import explore as X

    p = spark.createDataFrame([("சிகிரியா", "a", 1.0, 1.0), ("දඹුල්ල", "b", 2.0, 2.0), ("Ella Rock", "c", 3.0, 3.0), ("ella-rock", "d", 4.0, 4.0)], "name string, category string, lat double, lon double")
    u = spark.createDataFrame([("யாழ்", "MORNING", 1), ("මාතර", "EVENING", 2), ("ELLA ROCK", "NOON", 3)], "place_name string, time_of_day string, total_reviews int")
    w = spark.createDataFrame([("க", "1", "2", "x", "t"), ("Ella Rock", "1", "2", "x", "t")], "poi_name string, latitude string, longitude string, wiki_category string, rag_text string")
    got = sorted((r.name, r.time_of_day or "", r.rag_text or "") for r in X.merge_places(p, u, w, {}).collect())
    assert got == sorted([("சிகிரியா", "", ""), ("දඹුල්ල", "", ""), ("Ella Rock", "NOON", "t"), ("யாழ்", "MORNING", ""), ("මාතර", "EVENING", "")])


def test_notes_are_templates(spark):
    from pyspark.sql import functions as F

    from placelore.functions.text import fill

    row = spark.range(1).select(fill("{id} of {x}{y}", {"id": F.col("id"), "x": F.lit("a"), "y": F.lit(2.5)}).alias("t"), fill("{id} {n}", {"id": F.col("id"), "n": F.lit(None)}).alias("n")).first()
    assert row.t == "0 of a2.5" and row.n is None


def test_five_answers_reach_the_context_and_its_score(spark):
    from types import SimpleNamespace

    from placelore.operators import graphq as G
    from placelore.plans import q_graph

    turns = spark.createDataFrame([(1, t, "assistant", f"answer {t}") for t in range(1, 7)] + [(1, 0, "user", "ask")], "conv_id bigint, turn int, role string, text string")
    v = SimpleNamespace(questions=spark.createDataFrame([(100,)], "qid bigint"), table=lambda name: turns)
    docs = q_graph._docs(v)
    assert sorted(r.turn for r in docs.collect()) == [1, 2, 3, 4, 5]
    facts = spark.createDataFrame([], "qid bigint, pct double")
    assert [r.text_score for r in G.retrieval_quality(facts, docs, v.questions).collect()] == [1.0]


def test_normalizer_computes_each_rule_once(spark):
    plan = N.normalized(spark.createDataFrame([("x",)], "text string"))._jdf.queryExecution().optimizedPlan().toString()
    # copied into every branch that reads it, a slot's pattern stood there dozens of times and the code was too long to compile
    assert plan.count("early (?:in the )?mornings?") <= 3
    assert plan.count(" AS _amounts#") == 1


def test_alternation_finds_what_its_patterns_find():
    from placelore.functions import rules as R

    words = "early in the morning 5 pm noon sunset before 8 midday dry months no fee rs. 500 us$ 3 way too much of a crowd packed not busy waterfalls november sunrises unpacked x9 am"
    texts = [words] + words.split() + [" ".join(words.split()[i:i + 3]) for i in range(0, 30)]
    tables = [ps for t in (R.TIME_OF_DAY, R.SEASON, R.CROWD_LEVELS, R.COST_OPINION) for _, ps in t] + [[R.AMOUNT], [R.HEAT], [r"\bfalls?|waterfall\b", r"\bnoon\b"], [r"x?", "a"]]
    for ps in tables:
        for t in texts:
            assert bool(re.search(N.alternation(ps), t)) == any(re.search(p, t) for p in ps), (ps, t)


def test_normalizer_matches_rules_a_column_at_a_time(spark):
    """F16, F18, F19, F22 to F24, F43, F44: some sixty regexes per review in the JVM took most of the time."""
    texts = [None, "", "am", "RS", "at 5pm, am. o'clock", "It’s NOT in the morning", "price.rs,am", "don't come at sunset, early morning is best", "may or july", "100 rupees, foreigners $5.50 usd",
             "Never crowded on a weekend", "avoid poya and the week day", "no other people\n at noon", " very quiet ", "hot in the afternoon, not at night", "overpriced but worth it", "entrance fee"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = N.normalized(df)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= 6 and plan.count("ArrowEvalPython") == 1
    low = F.col("low_text")
    want = {"tag_best_time": N.keyword_tag(low, "best_time"), "tag_crowd": N.keyword_tag(low, "crowd_level"), "tag_cost": N.keyword_tag(low, "cost_level"), "time_of_day": N.time_of_day(low),
            "season": N.season(low), "months": N.months(low), "recommend_day": N.recommended_day(low), "avoid": N.avoided_days(low), "crowd_level": N.crowd_level(low), "crowd_when": N.crowd_when(low),
            "amount_lkr": N.amount_lkr(low), "opinion_level": N.opinion_level(low), "fee_type": N.fee_type(low), "evaluation": N.evaluation_word(low)}
    for r in got.select("text", *want, *[c.alias(f"_{k}") for k, c in want.items()]).collect():
        assert {k: r[k] for k in want} == {k: r[f"_{k}"] for k in want}, r.text


def test_first_tagged_sentence(spark):
    from placelore.functions import text as X

    df = spark.createDataFrame([("Hi.  Free! no.x Crowded?  at 5 am",), ("a.  　 . crowd",), (None,), ("",), ("am",), ("Nothing. The fee, too.\nQuiet",)], "text string")
    for c in ("best_time", "crowd_level", "cost_level"):
        old = F.try_element_at(F.filter(X.sentences(F.col("text")), lambda s: N.keyword_tag(s, c)), F.lit(1))
        assert all(r.a == r.b for r in df.select(N.first_tagged(F.col("text"), c).alias("a"), old.alias("b")).collect())


def test_published_profiles_are_made_once(spark):
    from placelore.plans import all_queries

    plan = all_queries()[0]["s13_publish_profiles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan  # it held the scan of all reviews twice, for the names that match and for those that do not


def test_pages_with_cut_entities_equal_their_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as E

    pages = ["<title>one &quot</title> &quot;two&quot; &middot; &copy; x", "a &amp b &amp; c &am d & e &ampquot f", "&quo &copy &middot z &amp;quot; &ampcopy;", None, ""]
    spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(E.oracle_sql()["t5_clean_pages"]).fetchall())
    assert sorted(map(tuple, E.queries()["t5_clean_pages"](spark, str(tmp_path)).collect())) == want
