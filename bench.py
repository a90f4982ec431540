"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run to the end with a no-op write, so that all rows and columns are produced and none pass the driver.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from placelore.plans import all_queries  # noqa: E402
from placelore.session import local_session  # noqa: E402

HEADLINES = ["flagship_popular_terms", "a15_tf_idf", "j14_similar_places", "t15_sentences", "f2_english_filter", "x1_url_dedup", "x2_exact_text_dedup", "x3_near_duplicate_pairs",
             "a2_a3_tag_report", "a7_a10_place_profiles", "m10_m13_activity_triples", "a25_quadratic_kappa", "a26_threshold_sweep", "v1_net_scores", "v7_dense_topk",
             "q1_activity_places", "q10_j17_nearest_places", "a35_w3_route_metrics", "p1_nearest_neighbour", "p2_best_order", "w4_day_split", "m20_history_similarity", "k6_similar_places"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, 16)
    table, _ = all_queries()
    only = set(sys.argv[1:])
    times = {}
    table["x1_url_dedup"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up, not timed
    for name in HEADLINES:
        if only and name not in only:
            continue
        start = time.time()
        try:
            table[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
        except Exception as error:  # noqa: BLE001
            times[name] = None
            print(f"{name}: {error}"[:300], file=sys.stderr)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(t for t in times.values() if t), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


main()
