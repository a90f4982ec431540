"""Exact top-k by inner product: columnar branch and bound over blocks.

Vectors are dealt into blocks stored dimension by dimension. For a query, scores are accumulated over a few dimensions at
a time for all vectors of a block; what the remaining dimensions can still add is at most the product of the remaining
norms, so vectors that cannot reach the query's k-th score drop out and the survivors are compacted. Whole numbers are
used throughout, so nothing is lost to rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from placelore.llm.common import written

BLOCK = "dim int, block long, ids binary, data binary"
EXACT = 2.0**52


def whole(vector: Column, scale: int = 64) -> Column:
    """floor(scale * component) as longs; null if the vector or a component is null or not finite, or it is empty."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """(vec_id, v) as rows of up to ``rows`` vectors of one dimension: ids, and the matrix dimension by dimension.

    Cut within the partitions as they come, so nothing is shuffled; ``block`` is a number within the partition.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        made = 0

        def out(dim):
            nonlocal made
            made += 1
            ids, data = held.pop(dim)
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "block": [made], "ids": pa.array([np.concatenate(ids).tobytes()], pa.binary()),
                                               "data": pa.array([np.ascontiguousarray(np.concatenate(data).T).tobytes()], pa.binary())})

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, values = batch.column("vec_id").to_numpy(), batch.column("v").flatten().to_numpy()
            sizes = batch.column("v").value_lengths().to_numpy()
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            for dim in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == dim)
                for lo in range(0, len(mine), rows):
                    some = mine[lo:lo + rows]
                    kept = held.setdefault(dim, ([], []))
                    kept[0].append(ids[some])
                    kept[1].append(values[starts[some][:, None] + np.arange(dim)])
                    if sum(map(len, kept[0])) >= rows:
                        yield out(dim)
        for dim in list(held):
            yield out(dim)

    return vectors.mapInArrow(cut, BLOCK)


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, columns: np.ndarray, k: int, step: int) -> tuple[list, list, list]:
    """Top k of one block (columns: dims x vectors) for each query (rows), the query's own id left out."""
    dims, n = columns.shape
    energy = np.argsort(-(columns.astype(np.float64) ** 2).sum(axis=1), kind="stable")  # heavy dimensions first
    q_all = queries[:, energy]
    reach = np.sqrt((q_all.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) * np.sqrt((columns.astype(np.float64) ** 2).sum(axis=0).max(initial=0))
    kind = np.float64 if reach < EXACT else np.int64  # floats hold the whole numbers exactly below the bound
    cols, q_all = columns[energy].astype(kind), q_all.astype(kind)
    cuts = list(range(0, dims, step))
    square = cols.astype(np.float64) ** 2
    rest = [np.sqrt(square[c + step:].sum(axis=0)) for c in cuts]
    out: tuple[list, list, list] = ([], [], [])
    for qid, q in zip(query_ids.tolist(), q_all):
        alive = np.flatnonzero(ids != qid)
        if not len(alive):
            continue
        score, floor = np.zeros(len(alive), kind), None
        q_rest = [np.sqrt((q[c + step:].astype(np.float64) ** 2).sum()) for c in cuts]
        for i, c in enumerate(cuts):
            block = cols[c:c + step]
            score = score + q[c:c + step] @ (block if len(alive) == n else block[:, alive])
            if c + step >= dims or len(alive) <= k:
                continue
            if floor is None:  # exact scores of the k that lead now: no later answer is worse than the least of them
                lead = alive[np.argpartition(-score, k - 1)[:k]]
                floor = (q @ cols[:, lead]).min()
            stay = score + q_rest[i] * rest[i][alive] * (1 + 1e-9) + 1e-6 >= floor
            alive, score = alive[stay], score[stay]
        best = np.lexsort((ids[alive], -score))[:k]
        out[0].extend([qid] * len(best))
        out[1].extend(ids[alive[best]].tolist())
        out[2].extend(int(s) for s in score[best])
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, query_rows: int = 4096, block_rows: int = 8192, step: int = 16) -> DataFrame:
    """For each query row of ``vectors`` (vec_id, embedding): query_id, rank, vec_id and score of its k best other rows.

    Ties go to the smaller vec_id. Rows with a null id and vectors that are null or hold null or non-finite components
    take no part; vectors of different length are not compared. Rows that repeat an id are all candidates, but a query
    is asked once per id (its first row by vector). Scores must fit a long.
    """
    valid = vectors.select(F.col("vec_id").cast("long"), whole(F.col("embedding")).alias("v")).filter("vec_id is not null and v is not null")
    asked = valid.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    total = asked.count()
    groups = max(1, -(-total // query_rows))
    queries = written(blocks(asked.repartition(groups, "vec_id"), query_rows).select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.monotonically_increasing_id().alias("q")), "queries")
    # every block of vectors meets every block of queries of its dimension; with few query blocks the cells are salted
    numbered = queries.select("dim", "q").groupBy("dim").agg(F.collect_list("q").alias("all_q"))  # one number per query_rows queries
    salts = max(1, -(-4 * vectors.sparkSession.sparkContext.defaultParallelism // groups))
    cells = (blocks(valid, block_rows).withColumn("salt", F.pmod(F.xxhash64(F.spark_partition_id(), "block"), salts))
             .join(F.broadcast(numbered), "dim").withColumn("q", F.explode("all_q")).drop("all_q", "block"))
    salted = queries.drop("dim").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row].as_py()  # noqa: E731, B023
                dim = get("dim")
                ids, q_ids = np.frombuffer(get("ids"), np.int64), np.frombuffer(get("q_ids"), np.int64)
                found = search(q_ids, np.frombuffer(get("q_data"), np.int64).reshape(dim, -1).T, ids, np.frombuffer(get("data"), np.int64).reshape(dim, -1), k, step)
                yield pa.RecordBatch.from_pydict({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), found)})

    met = cells.join(salted, ["q", "salt"]).select("dim", "ids", "data", "q_ids", "q_data")
    best = met.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
