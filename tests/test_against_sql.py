"""A selection of registered queries against their SQL on the smallest tables (the full set: tools/check.py)."""

import duckdb
import pytest

import __spark_entry__ as E

DIR = "/root/testdata/sf0.001"
NAMES = ["flagship_popular_terms", "a15_tf_idf", "j14_similar_places", "x1_url_dedup", "a21_categorical_metrics", "a25_quadratic_kappa", "a26_threshold_sweep", "m20_history_similarity",
         "w4_day_split", "q1_activity_places", "q10_j17_nearest_places", "v1_net_scores", "v7_dense_topk", "v8_bm25_topk", "k6_similar_places", "j24_weather_grid", "t15_sentences",
         "j16_past_trip_weights", "j16_matched_missing", "x3_near_duplicate_pairs", "x4_drop_near_duplicates", "t31_context_blocks", "a37_retrieval_quality", "w6_rank_among_orders", "p7_shortest_paths",
         "m14_question_terms", "q2_j8_feature_places", "q9_multi_criteria", "q10_nearby_chain", "q12_crowd", "q13_cost", "m26_evidence_projection", "r1_review_stream"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    cur = con.execute(E.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted([tuple(str(dict(zip(names, r))[c]) for c in sorted(names)) for r in cur.fetchall()])
    df = E.queries()[name](spark, DIR)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(str(r[c]) for c in sorted(names)) for r in df.collect()) == want


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert E.entry
