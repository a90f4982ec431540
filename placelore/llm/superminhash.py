"""Near-duplicates by SuperMinHash signatures, banding, exact verification and union-find.

A document's set holds its distinct five-word shingles. SuperMinHash gives every element one random permutation of the
signature's components and lets it offer ``j + u`` to the component at rank j; ranks are correlated, so the variance is
lower than that of independent permutations, and an element stops at the rank above which no component can change.

Documents with equal sets are one class. Classes that share a band of the signature meet in a bucket; the smallest class
of a bucket is its hub, and every other one is compared with the hub exactly, as the list of shingles in which the two
differ. Two classes x, y around one hub differ in ``dx + dy - 2 * overlap`` shingles, where the overlap counts the
differences from the hub that both have. If they have none in common and are similar, each of them is similar to the
hub as well; so only those in another component than their hub are compared with the others around it, in blocks, from
the differences alone, and of the links found only those that join two components are kept. No link between classes that
share a bucket is lost to the groups, and neither copies nor near copies are expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelore.llm.common import slices, written
from placelore.llm.unionfind import components

GOLDEN, M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = np.uint64(0x100000001B3)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, elementwise."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * M1
        x = (x ^ (x >> np.uint64(27))) * M2
        return x ^ (x >> np.uint64(31))


def signatures(elements: np.ndarray, owner: np.ndarray, sets: int, m: int) -> np.ndarray:
    """SuperMinHash of several sets at once: a (sets, m) array of values j + u as floats, infinite for empty sets.

    ``elements`` are 64-bit hashes, ``owner`` the row of each element's set.
    """
    flat = np.full(sets * m, np.inf)
    swaps: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        for j in range(m):
            if not len(elements):
                break
            r = mix(elements + GOLDEN * np.uint64(2 * j + 1))
            k = (j + (mix(elements + GOLDEN * np.uint64(2 * j + 2)) >> np.uint64(32)) * np.uint64(m - j) // np.uint64(1 << 32)).astype(np.int64)
            at = k
            for t in range(j - 1, -1, -1):  # where the swaps before moved what now stands at k
                at = np.where(swaps[t] == at, t, at)
            np.minimum.at(flat, owner * m + at, j + (r >> np.uint64(11)).astype(np.float64) * 2.0**-53)
            swaps.append(k)
            going = (flat.reshape(sets, m).max(axis=1) > j + 1)[owner]
            if not going.all():
                elements, owner, swaps = elements[going], owner[going], [s[going] for s in swaps]
    return flat.reshape(sets, m)


def shingles(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``size`` words; fewer words are one run, no words an empty set.

    Words are what stands between ASCII white space, with A-Z lower-cased.
    """
    words = (text or b"").lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    runs = max(1, len(h) - size + 1) if len(h) else 0
    total = np.zeros(runs, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(size, len(h))):
            total = mix(total * BASE + h[k:k + runs])
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])] if runs else total


def profile(docs: DataFrame, size: int, rows: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the set, null if empty) and the band hashes of the signature."""
    m = rows * bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingles(t, size) for t in batch.column("text").to_pylist()]
            n = np.array([len(x) for x in sets], np.int64)
            sig = signatures(np.concatenate(sets), np.repeat(np.arange(len(sets)), n), len(sets), m)
            part = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sets), bands, rows)
            key = np.zeros((len(sets), bands), np.uint64) + mix(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN)
            with np.errstate(over="ignore"):
                for r in range(rows):
                    key = mix(key * BASE + part[:, :, r])
            flat = pa.array(key.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n), pa.array([xxhash.xxh128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), flat)], names=["doc_id", "n_shingles", "set_key", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n and the set as an array of longs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingles(t, size).view(np.int64) for t in batch.column("text").to_pylist()]
            n = np.array([len(x) for x in sets], np.int64)
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["doc_id", "n", "items"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n long, items array<long>")


def linked_in(left: list[tuple], right: list[tuple], percent: int) -> list[tuple]:
    """Links between stragglers (left) and members (right) of one hub that join labels which nothing joined before.

    Entries are (class, n, differences, label); classes of one label are in one component already, so at most one link
    less than there are labels is given, whatever the number of similar pairs.
    """
    plus, minus = 100 + percent, 100 - percent
    dx, dy = np.array([len(x[2]) for x in left]), np.array([len(y[2]) for y in right])
    ex = plus * dx - minus * np.array([x[1] for x in left])
    ey = plus * dy - minus * np.array([y[1] for y in right])
    need = ex[:, None] + ey[None, :]
    open_ = (need <= 2 * plus * np.minimum(dx[:, None], dy[None, :])) & (np.array([x[3] for x in left])[:, None] != np.array([y[3] for y in right])[None, :])
    rows, cols = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
    if not len(rows):
        return []
    have = np.unique(np.concatenate([left[i][2] for i in rows]))
    shared = np.intersect1d(have, np.concatenate([right[j][2] for j in cols]))
    overlap = np.zeros((len(rows), len(cols)), np.float32)
    for lo in range(0, len(shared), 4096):
        block = shared[lo:lo + 4096]
        a, b = (np.stack([np.isin(block, side[i][2], assume_unique=True) for i in at]).astype(np.float32) for side, at in ((left, rows), (right, cols)))
        overlap += a @ b.T
    good = open_[np.ix_(rows, cols)] & (need[np.ix_(rows, cols)] <= 2 * plus * overlap.astype(np.int64))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    out = []
    for i, j in np.argwhere(good).tolist():
        x, y = left[rows[i]], right[cols[j]]
        p, q = root(x[3]), root(y[3])
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x[0], y[0]))
    return out


def straggler_links(around: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) around each hub that join what the links to hubs leave apart.

    ``around``: hub, class, n, differences, label (the component by links to hubs), linked (if it is the hub's component).
    Members and stragglers of a hub are dealt into blocks of about ``block`` classes; a pair of blocks is one piece of work,
    so a hub with any number of members is shared out. A piece gives fewer links than it has labels.
    """
    sizes = around.groupBy("hub").agg(F.count("*").alias("members"), F.count_if(~F.col("linked")).alias("strays")).filter("strays > 0 and members > 1")
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    deal = lambda n: F.pmod(F.xxhash64("class"), blocks(n)).cast("int")
    near = around.join(sizes, "hub")
    right = near.select("hub", "class", "n", "differences", "label", F.lit(False).alias("left"), deal("members").alias("r"), F.explode(F.sequence(F.lit(0), blocks("strays") - 1)).alias("l"))
    left = near.filter(~F.col("linked")).select("hub", "class", "n", "differences", "label", F.lit(True).alias("left"), deal("strays").alias("l"), F.explode(F.sequence(F.lit(0), blocks("members") - 1)).alias("r"))
    keys = ["hub", "l", "r"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pairs):
            return pa.RecordBatch.from_pydict({"a": pa.array([min(p) for p in pairs], pa.int64()), "b": pa.array([max(p) for p in pairs], pa.int64())})

        at, sides = None, ([], [])
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in (*keys, "class", "n", "label", "left")]
            flat, ends = batch.column("differences").flatten().to_numpy(), np.concatenate([[0], np.cumsum(batch.column("differences").value_lengths().to_numpy())]).tolist()
            for i, (hub, lb, rb, name, n, label, is_left) in enumerate(zip(*cols)):
                if (hub, lb, rb) != at:
                    if all(sides) and (found := linked_in(*sides, percent)):
                        yield out(found)
                    at, sides = (hub, lb, rb), ([], [])
                sides[0 if is_left else 1].append((name, n, flat[ends[i]:ends[i + 1]].copy(), label))
        if all(sides) and (found := linked_in(*sides, percent)):
            yield out(found)

    cells = right.unionByName(left).repartition(*keys).sortWithinPartitions(*keys)
    return cells.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 5, rows: int = 4, bands: int = 16, block: int = 128) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable), kept.

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets, counted exactly; pairs are
    found if they share one of the bands (with 4 rows and 16 bands all but 8 in a million at a similarity of 0.85, and
    rows of one group have many ways to meet). Null texts and texts without words have an empty set and are linked with
    nothing. Repeated rows are copies of each other. Rows with a null doc_id get the group's component; they are kept
    only if they are in none. If a doc_id stands for several texts, it is one node that has the links of all of them.
    """
    marked = written(profile(docs, size, rows, bands), "signatures")
    reps = written(marked.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("class")), "representatives")  # joined as a table, so that Spark can split a set that many rows have
    classed = written(marked.join(reps, "set_key", "left").select("doc_id", "n_shingles", "class", F.when(F.col("doc_id") == F.col("class"), F.col("bands")).alias("bands")), "classes")
    keys = classed.filter("bands is not null").select("class", F.explode("bands").alias("bucket"))
    hubs = written(keys.groupBy("bucket").agg(F.min("class").alias("hub"), F.max("class").alias("last")).filter("hub < last").select("bucket", "hub"), "hubs")
    pairs = written(keys.join(hubs, "bucket").filter("class <> hub").select("hub", "class").distinct(), "pairs")
    asked = pairs.select(F.col("class").alias("doc_id")).union(pairs.select("hub")).distinct()
    # the same join at every size: the ids asked for grow with the corpus, so they are never broadcast
    sets = written(sets_of(docs.select("doc_id", "text").join(asked.hint("merge"), "doc_id", "left_semi"), size), "sets")
    a = sets.select(F.col("doc_id").alias("class"), "n", "items")
    b = sets.select(F.col("doc_id").alias("hub"), F.col("n").alias("hub_n"), F.col("items").alias("hub_items"))
    both = pairs.join(a, "class").join(b, "hub")
    differ = F.concat(F.array_except("items", "hub_items"), F.array_except("hub_items", "items"))
    around = both.select("hub", "class", "n", "hub_n", differ.alias("differences"))
    around = written(around.withColumn("linked", (100 - percent) * (F.col("n") + F.col("hub_n")) >= (100 + percent) * F.size("differences")), "around")
    star = around.filter("linked").select(F.col("hub").alias("a"), F.col("class").alias("b"))
    known = components(star)
    # a class may be linked to the hub of another bucket: only what is in another component than its hub is a straggler
    far = around.join(known.select(F.col("node").alias("class"), "label"), "class", "left").join(known.select(F.col("node").alias("hub"), F.col("label").alias("hub_label")), "hub", "left")
    far = far.select("hub", "class", "n", "differences", F.coalesce("label", "class").alias("label"), (F.coalesce("label", "class") == F.coalesce("hub_label", "hub")).alias("linked"))
    labels = components(star.unionByName(straggler_links(written(far, "labelled"), percent, block))).select(F.col("node").alias("class"), "label")
    named = classed.select("doc_id", "n_shingles", "class").join(labels, "class", "left")
    component = F.coalesce("label", "class", "doc_id")
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))
