"""Best-fit packing of token pieces into sequences under several capacities at once.

A piece is a vector (tokens, one document, attention cost = tokens squared), so all pieces of one length are alike. The
plan is therefore made over the histogram of lengths, which has at most ``capacity`` rows whatever the corpus holds:
lengths from the longest down, each into the open bins that fit best, many equal bins at a time. A piece then finds its
bin from its length and its rank among the pieces of that length. Ranks are counted where the pieces are made and
shifted by prefix sums, so no length is gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from placelore.llm.common import crc, encoder, slices, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, forget: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every document (doc_id, text), each document ended by ``end_id``.

    A null text is empty. Only documents longer than the capacity are cut; their first piece takes what is left over,
    the others are full. ``part`` and ``rank`` number the pieces of one length within a task. With ``forget`` a task lets go of
    its encoder's kept chunks when it ends; without, the worker's next task goes on with them.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, enc, end = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(tokenizer), np.uint32(end_id).tobytes()
        for batch in slices(batches, "text"):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode([t or "" for t in batch.column("text").to_pylist()])):
                ids += end
                n = len(ids) // 4
                size, lo, piece = (n - 1) % capacity + 1, 0, 0
                while lo < n:
                    rows.append((doc, piece, lo, size, crc(ids[4 * lo:4 * (lo + size)]), part, int(seen[size])))
                    seen[size] += 1
                    lo, piece, size = lo + size, piece + 1, capacity
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])
        if forget:
            enc.forget()

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], capacity: int = 2048, max_documents: int = 2048, max_cost: int | None = None,
         rule: str = "norm", weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)) -> list[tuple]:
    """Vector best-fit over a histogram of lengths: rows (length, lo, hi, sequence, copies, offset).

    Pieces of ``length`` with rank lo <= r < hi go to sequence ``sequence + (r - lo) // copies`` at
    ``offset + (r - lo) % copies * length``. A bin can take a piece only if the residuals of tokens, documents and
    attention cost all allow it. Among those, ``rule="norm"`` takes the bin with the smallest weighted norm of what
    stays free after the piece, ``rule="dot"`` the one with the largest weighted dot product of free room and piece;
    the bin opened first on ties. Equal bins are filled together, each with as many copies as fit.
    """
    max_cost = capacity * capacity if max_cost is None else max_cost
    caps, w = np.array([capacity, max_documents, max_cost], np.float64), np.array(weights)
    room = np.zeros((0, 3), np.int64)  # free tokens, documents and cost of each group of equal bins
    many, first = np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, opened, lengths = [], 0, sorted((n for n, c in counts.items() if c), reverse=True)
    for length in lengths:
        need, left, rank = np.array([length, 1, length * length]), counts[length], 0
        if (need > caps).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while left:
            fits = np.flatnonzero((room >= need).all(axis=1)) if len(room) else []
            if len(fits):
                free = room[fits] / caps
                score = (w * (free - need / caps) ** 2).sum(axis=1) if rule == "norm" else -(w * free * (need / caps)).sum(axis=1)
                at = fits[np.lexsort((first[fits], score))[0]]
            else:
                most = int((caps // need).min())
                bins = -(-left // most)
                room, many, first = np.vstack([room, caps.astype(np.int64)]), np.append(many, bins), np.append(first, opened)
                opened, at = opened + bins, len(room) - 1
            copies = int((room[at] // need).min())
            full = min(int(many[at]), left // copies)
            rest = left - full * copies if full < many[at] else 0
            start, have, before = int(first[at]), int(many[at]), room[at].copy()
            room, many, first = np.delete(room, at, 0), np.delete(many, at), np.delete(first, at)
            for bins, k in ((full, copies), (1 if rest else 0, rest), (have - full - (1 if rest else 0), 0)):
                if bins:
                    if k:
                        rows.append((length, rank, rank + bins * k, start, k, capacity - int(before[0])))
                        rank, left = rank + bins * k, left - bins * k
                    room, many, first = np.vstack([room, before - k * need]), np.append(many, bins), np.append(first, start)
                    start += bins
        open_ = room[:, 0] >= lengths[-1]
        room, many, first = room[open_], many[open_], first[open_]
    return rows


def pack(pieces: DataFrame, capacity: int = 2048, max_documents: int = 2048, max_cost: int | None = None,
         rule: str = "norm", weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)) -> DataFrame:
    """Pieces (length, part, rank and any columns) with sequence_id and the gapless offset in it.

    What reaches the driver is the histogram (at most ``capacity`` rows); the plan, a few rows per length, is broadcast.
    An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    here = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = here.select("part", "length", before.alias("base"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = plan(counts, capacity, max_documents, max_cost, rule, weights)
    bins = spark.createDataFrame(rows, "length long, lo long, hi long, first_sequence long, copies long, first_offset long")
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "part")
    nth = F.col("rank") - F.col("lo")
    return (ranked.join(F.broadcast(bins), (ranked["length"] == bins["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
            .select(*[ranked[c] for c in ranked.columns if c != "rank"], (F.col("first_sequence") + F.floor(nth / F.col("copies"))).alias("sequence_id"),
                    (F.col("first_offset") + nth % F.col("copies") * bins["length"]).alias("offset")))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, forget: bool = False, **limits) -> DataFrame:
    """Every token of every document in one sequence slot: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(written(token_pieces(docs, tokenizer, capacity, end_id, forget), "pieces"), capacity, **limits)
