"""Registered query that runs the review stream over the table's files to its end."""

import uuid

from pyspark.sql import functions as F

from placelore.plans.q_profiles import PROFILE_COLS, _join
from placelore.plans.registry import query
from placelore.session import shared_dir
from placelore.sources.proxies import notes_of
from placelore.streaming import review_stream as RS


@query("r1_review_stream", "select " + ", ".join(PROFILE_COLS) + " from v_profiles")
def r1(v):
    """Profiles kept by the stream: cleaned, each review once, one upsert per micro-batch of a file."""
    base = f"{shared_dir(v.spark).rstrip('/')}/review-stream-{uuid.uuid4().hex}"
    table = v.table("lineitem")
    stream = v.spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1)
    if any("/lineitem.parquet/" in name for name in table.inputFiles()):  # a folder of files
        lines = stream.parquet(f"{v.sf_dir}/lineitem.parquet")
    else:  # one file: a stream reads folders
        lines = stream.option("pathGlobFilter", "lineitem.parquet").parquet(v.sf_dir)
    reviews = notes_of(lines).withColumn("ts", F.col("travel_date").cast("timestamp")).withColumn("line", F.struct("review_id", "l_partkey", "l_discount", "text"))
    # travel dates span seven years in any order, so nothing within ten is late
    clean = RS.clean_stream(reviews, "3650 days", keys=("place_id", "line"))
    RS.profile_stream(clean, f"{base}/out", f"{base}/checkpoint", "place_id").awaitTermination()
    p = RS.current_profiles(v.spark, f"{base}/out")
    return p.select(*[_join(c) if c in ("months", "avoid", "busiest") else c for c in PROFILE_COLS])
