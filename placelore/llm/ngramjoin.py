"""Exact Jaccard join of word n-gram sets with signature trees.

Documents with equal sets are one class. A set's n-grams are put in one order for all sets, those of full buckets of a
count sketch last; two sets of the wanted similarity share one of the first ``n - ceil(similarity * n) + 1`` n-grams, so
each such n-gram that several classes have is the root of a tree, and pairs without a common root overlap too little.

The nodes of a tree hold the OR of their sets' token bitmaps, the range of set sizes and the largest excess of a size over
its set bits. Sets of two nodes can share no more tokens than the bits that both nodes have plus the excess; a pair of
nodes whose bound is below what the smallest sizes need is cut, and so is a pair whose sets are all in one component
already. The upper nodes are a table and meet by an equi join on root and neighbouring size class; pairs that survive
are walked down inside a task, level by level, to pairs of sets. Those are compared exactly.

Before the walk the sets of a root are compared with its smallest one, which joins most of a large group and settles roots
of two sets; roots with the same other sets are walked once. The walk has only pairs between different components left,
and no group is ever expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelore.llm.common import slices, written
from placelore.llm.phrases import field_of, inside
from placelore.llm.superminhash import shingles
from placelore.llm.unionfind import components

LONGS = 16
BITS = 64 * LONGS
SKETCH_BITS = 16
FAN_OUT = 8
COUNTED = 300


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in slices(batches, "text"):
        yield batch, [shingles(t, size) for t in batch.column("text").to_pylist()]


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """One row of LONGS 64-bit words per set; a token sets the bit that its top bits name."""
    bits = np.zeros((len(sets), BITS), bool)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    if len(owner):
        bits[owner, (np.concatenate(sets) >> np.uint64(64 - 10)).astype(np.int64)] = True
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def profile(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, set_key (digest of the set, null if empty), short (its first 64 bits), excess, the bitmap and, for sets of
    more than COUNTED tokens, whose bitmap is too full to tell much, the number of tokens behind each bit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, size):
            n = np.array([len(x) for x in sets], np.int64)
            keys = [xxhash.xxh128_digest(x.tobytes()) if len(x) else None for x in sets]
            bits = bitmaps(sets)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n), pa.array(keys, pa.binary()), pa.array([int.from_bytes(k[:8], "little", signed=True) if k else None for k in keys], pa.int64()),
                pa.array((n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)).astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * LONGS), pa.array(bits.ravel().view(np.int64))),
                pa.array([np.bincount((x >> np.uint64(64 - 10)).astype(np.int64), minlength=BITS).astype(np.int32) if len(x) > COUNTED else None for x in sets], pa.list_(pa.int32()))],
                names=["doc_id", "n", "set_key", "short", "excess", "bits", "counts"])

    return _texts(docs).mapInArrow(run, "doc_id long, n long, set_key binary, short long, excess int, bits array<long>, counts array<int>")


def sketch(docs: DataFrame, size: int) -> np.ndarray:
    """How many n-grams of all sets fall into each of 2^SKETCH_BITS buckets; of this size at any size of the corpus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for _, sets in _sets(batches, size):
            total += np.bincount((np.concatenate(sets) & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=1 << SKETCH_BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    counts = _texts(docs).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    total[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    return total


def prefixes(docs: DataFrame, size: int, percent: int, counts: np.ndarray, keep: int = 200_000) -> DataFrame:
    """(key, short, hot): the n-grams of each set that a similar set must share one of.

    ``hot`` marks buckets of the sketch far above the mean, whose n-grams need not be looked at to know that they are
    shared. A task gives the rows of a set once, as long as it remembers it (``keep`` sets).
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(counts)
    limit = 1000 + 4 * int(counts.mean())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = shared.value, set()
        for _, sets in _sets(batches, size):
            names, parts, hot = [], [], []
            for x in sets:
                if not len(x):
                    continue
                name = int.from_bytes(xxhash.xxh128_digest(x.tobytes())[:8], "little", signed=True)
                if name in seen:
                    continue
                seen.add(name)
                most = len(x) + percent * len(x) // -100 + 1
                full = order[(x & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]
                at = np.lexsort((x, full))[:most]
                names.append((name, most)), parts.append(x[at]), hot.append(full[at] > limit)
            if len(seen) > keep:
                seen = set()
            if parts:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.repeat(np.array([k for k, _ in names], np.int64), [m for _, m in names])), pa.array(np.concatenate(hot))], names=["key", "short", "hot"])

    return _texts(docs).mapInArrow(run, "key long, short long, hot boolean")


def shared_keys(rows: DataFrame) -> DataFrame:
    """The distinct rows (key, short) whose key has several values of short; keys are streamed in order, never gathered."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, short, before = np.zeros(0, np.int64), np.zeros(0, np.int64), False  # what waits, and if its key was there before it
        for batch in filter(len, batches):
            key, short = (np.concatenate([old, batch.column(i).to_numpy()]) for i, old in enumerate((key, short)))
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (short[1:] != short[:-1])])
            key, short = key[new], short[new]
            same = key[1:] == key[:-1]
            out = np.concatenate([[before], same]) | np.concatenate([same, [False]])
            if out[:-1].any():
                yield pa.RecordBatch.from_arrays([pa.array(key[:-1][out[:-1]]), pa.array(short[:-1][out[:-1]])], names=["key", "short"])
            before = bool(out[-1])
            key, short = key[-1:], short[-1:]
        if before:
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(short)], names=["key", "short"])

    cold = rows.filter("not hot").select("key", "short").repartition("key").sortWithinPartitions("key", "short").mapInArrow(run, "key long, short long")
    return cold.unionByName(rows.filter("hot").select("key", "short").distinct())


def sets_of(docs: DataFrame, size: int, field: np.ndarray) -> DataFrame:
    """class (the doc_id), n and the set as an array of longs, of the documents whose id is in the bit field."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = (b.filter(pa.array(inside(sent.value, b.column("doc_id").to_numpy().view(np.uint64)))) for b in batches)
        for batch, sets in _sets(chosen, size):
            n = np.array([len(x) for x in sets], np.int64)
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["class", "n", "items"])

    return _texts(docs.filter("text is not null and doc_id is not null")).mapInArrow(run, "class long, n long, items array<long>")


def possible(percent: int, low_a, high_a, low_b, high_b, excess_a, excess_b, common):
    """If two nodes can hold a similar pair: size ranges, then the most tokens that two of their sets can share.

    Works on numbers, arrays and columns; ``high`` are the largest sizes, ``common`` the bits that both nodes have.
    """
    need = percent * (low_a + low_b)
    both = 100 + percent
    return (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a) & (both * (common + excess_a) >= need) & (both * (common + excess_b) >= need)


class Tree:
    """A signature tree over the sets of one upper node: names, sizes, excesses, labels and bitmaps, OR-combined upward."""

    def __init__(self, names, n, excess, labels, bits):
        at = np.lexsort((n, bits[:, 1], bits[:, 0], labels))
        self.names = names[at]
        level = (n[at], n[at], excess[at], labels[at], labels[at], bits[at])
        self.levels = [level]
        while len(level[0]) > 1:
            cut = np.arange(0, len(level[0]), FAN_OUT)
            low, high, over, first, last, bit = level
            level = (np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(over, cut), np.minimum.reduceat(first, cut), np.maximum.reduceat(last, cut), np.bitwise_or.reduceat(bit, cut, axis=0))
            self.levels.append(level)

    def level(self, k: int):
        return self.levels[min(k, len(self.levels) - 1)]


def walk(left: Tree, right: Tree, percent: int, same: bool) -> list[tuple[int, int]]:
    """Dual traversal from the two roots down: the pairs of sets that no bound excludes, not in one component yet."""
    out, top = [], max(len(left.levels), len(right.levels)) - 1
    frontier = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while frontier:
        depth, i, j = frontier.pop()
        (low_a, high_a, over_a, first_a, last_a, bit_a), (low_b, high_b, over_b, first_b, last_b, bit_b) = left.level(depth), right.level(depth)
        common = np.bitwise_count(bit_a[i] & bit_b[j]).sum(axis=1, dtype=np.int64)
        good = possible(percent, low_a[i], high_a[i], low_b[j], high_b[j], over_a[i], over_b[j], common)
        good &= ~((first_a[i] == last_a[i]) & (first_b[j] == last_b[j]) & (first_a[i] == first_b[j]))
        i, j = i[good], j[good]
        if depth == 0:
            keep = i < j if same else np.ones(len(i), bool)
            out += zip(left.names[i[keep]].tolist(), right.names[j[keep]].tolist())
            continue
        def children(tree, at):
            if depth >= len(tree.levels):  # this tree is lower: it waits at its root
                return at[:, None]
            kids = at[:, None] * FAN_OUT + np.arange(FAN_OUT)
            return np.where(kids < len(tree.level(depth - 1)[0]), kids, -1)
        a, b = children(left, i), children(right, j)
        x, y = np.repeat(a, b.shape[1], axis=1).ravel(), np.tile(b, (1, a.shape[1])).ravel()
        keep = (x >= 0) & (y >= 0) & ((x <= y) if same else True)
        x, y = x[keep], y[keep]
        frontier += [(depth - 1, x[lo:lo + 65_536], y[lo:lo + 65_536]) for lo in range(0, len(x), 65_536)]
    return out


def tree_pairs(members: DataFrame, percent: int, block: int) -> DataFrame:
    """Candidate pairs (a, b) of different components under common roots.

    ``members``: key, class, n, excess, bits, label, of roots with several components. The sets of a root are dealt by size class and label into upper
    nodes of about ``block`` sets; the pairs of upper nodes that no bound excludes are each walked in one task.
    """
    grade = F.floor(F.log("n") / float(np.log(100 / percent) / 2)).cast("int").alias("grade")
    rows = members.withColumn("grade", grade)
    sizes = rows.groupBy("key", "grade").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = written(rows.join(sizes, ["key", "grade"]).withColumn("node", F.pmod(F.xxhash64("label"), F.col("blocks")).cast("int")).drop("blocks"), "members")
    bits = [F.bit_or(F.col("bits")[i]).alias(f"b{i}") for i in range(LONGS)]
    nodes = written(rows.groupBy("key", "grade", "node").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("excess").alias("excess"), F.min("label").alias("first"), F.max("label").alias("last"), *bits), "nodes")
    side = lambda t: nodes.select("key", *[F.col(c).alias(f"{c}_{t}") for c in nodes.columns if c != "key"])
    # sizes differ by 100 / percent at most, so grades by 3
    a = side("a").withColumn("grade_b", F.explode(F.expr("sequence(grade_a, grade_a + 3)")))
    met = a.join(side("b"), ["key", "grade_b"]).filter("grade_a < grade_b or node_a <= node_b")
    common = sum((F.bit_count(F.col(f"b{i}_a").bitwiseAND(F.col(f"b{i}_b"))) for i in range(LONGS)), F.lit(0))
    fits = possible(percent, *[F.col(c) for c in ("low_a", "high_a", "low_b", "high_b", "excess_a", "excess_b")], common)
    one = "first_a = last_a and first_b = last_b and first_a = first_b"
    units = written(met.filter(fits & ~F.expr(one)).select("key", "grade_a", "node_a", "grade_b", "node_b"), "units")
    unit = ["key", "grade_a", "node_a", "grade_b", "node_b"]

    def shipped(t: str, left: bool) -> DataFrame:
        on = rows.select("key", F.col("grade").alias(f"grade_{t}"), F.col("node").alias(f"node_{t}"), "class", "n", "excess", "label", "bits")
        return units.join(on, ["key", f"grade_{t}", f"node_{t}"]).select(*unit, F.lit(left).alias("left"), "class", "n", "excess", "label", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(cell, parts):
            rows_ = pa.Table.from_batches(parts)
            trees = []
            for flag in (True, False):
                part = rows_.filter(pc.equal(rows_.column("left"), flag)).combine_chunks()
                if not len(part):
                    return None
                flat = part.column("bits").combine_chunks()
                trees.append(Tree(*[part.column(c).to_numpy() for c in ("class", "n", "excess", "label")], flat.flatten().to_numpy().view(np.uint64).reshape(-1, LONGS)))
            pairs = walk(*trees, percent, cell[1:3] == cell[3:5])
            return pa.RecordBatch.from_pydict({"a": pa.array([min(p) for p in pairs], pa.int64()), "b": pa.array([max(p) for p in pairs], pa.int64())}) if pairs else None

        at, parts = None, []
        for batch in batches:
            cells = list(zip(*[batch.column(c).to_pylist() for c in unit]))
            edges = [0, *[i for i in range(1, len(cells)) if cells[i] != cells[i - 1]], len(cells)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if cells[lo] != at:
                    if parts and (found := done(at, parts)) is not None:
                        yield found
                    at, parts = cells[lo], []
                parts.append(batch.slice(lo, hi - lo))
        if parts and (found := done(at, parts)) is not None:
            yield found

    cells = shipped("a", True).unionByName(shipped("b", False)).repartition(*unit).sortWithinPartitions(*unit)
    return cells.mapInArrow(run, "a long, b long").distinct()


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, counted on the whole sets."""
    a, b = (sets.select(F.col("class").alias(t), F.col("n").alias(f"n_{t}"), F.col("items").alias(f"items_{t}")) for t in "ab")
    both = pairs.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("items_a", "items_b")))
    return both.filter(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def with_bits(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that no bound excludes; two sets share at most the smaller count behind each bit."""
    for t in "ab":
        pairs = pairs.join(classes.select(F.col("class").alias(t), *[F.col(c).alias(f"{c}_{t}") for c in ("n", "excess", "bits", "counts")]), t)
    common = sum((F.bit_count(F.col("bits_a")[i].bitwiseAND(F.col("bits_b")[i])) for i in range(LONGS)), F.lit(0))
    fits = possible(percent, F.col("n_a"), F.col("n_a"), F.col("n_b"), F.col("n_b"), F.col("excess_a"), F.col("excess_b"), common)
    most = F.aggregate(F.zip_with("counts_a", "counts_b", lambda x, y: F.least(x, y)), F.lit(0), lambda acc, x: acc + x)
    counted = F.coalesce((100 + percent) * most.cast("long") >= percent * (F.col("n_a") + F.col("n_b")), F.lit(True))
    return pairs.filter(fits).filter(counted).select("a", "b").distinct()


def links(docs: DataFrame, classes: DataFrame, percent: int = 85, size: int = 4, block: int = 512) -> DataFrame:
    """Links (a, b) between class representatives that join all classes which similar pairs connect.

    A pair of similar classes is missing from the result only if other links connect the two.
    """
    rows = written(prefixes(docs, size, percent, sketch(docs, size)), "prefixes")
    keyed = written(shared_keys(rows).join(classes.select("short", "class", "n"), "short").select("key", "class", "n"), "keyed")
    hubs = keyed.groupBy("key").agg(F.min(F.struct("class", "n")).alias("hub"), F.count("*").alias("members"))
    spokes = written(keyed.join(hubs, "key").filter(F.col("class") != F.col("hub.class")).select("key", "class", "n", "hub", "members"), "spokes")
    sized = spokes.filter((100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")))
    star = written(with_bits(sized.select(F.col("hub.class").alias("a"), F.col("class").alias("b")).distinct(), classes, percent), "star")
    near = written(with_sets(docs, star, size, percent), "near")
    label = components(near).select(F.col("node").alias("class"), "label")
    # all that is left of a root are the pairs without its hub
    rest = spokes.filter("members > 2").select("key", "class").join(label, "class", "left").select("key", "class", F.coalesce("label", "class").alias("label"))
    groups = rest.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.bit_xor(F.xxhash64("class")).alias("s"), F.bit_xor(F.xxhash64("class", F.lit(7))).alias("x"), F.count("*").alias("c"))
    # roots with the same sets have the same pairs: one of them stands for all
    roots = written(groups.filter("low < high").groupBy("s", "x", "c").agg(F.min("key").alias("key")).select("key"), "roots")
    members = written(rest.join(roots, "key").join(classes.select("class", "n", "excess", "bits"), "class"), "members")
    again = written(with_bits(tree_pairs(members, percent, block), classes, percent), "candidates")
    return near.unionByName(written(with_sets(docs, again, size, percent), "linked"))


def with_sets(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The similar ones of ``pairs``.

    The ids that pairs name fill a bit field of fixed size, by which the scan leaves out other texts; what a false bit
    lets through finds no pair. So texts are not shuffled, and only these sets are written.
    """
    asked = pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct()
    return similar(pairs, written(sets_of(docs, size, field_of(asked)), "sets"), percent)


def jaccard_join(docs: DataFrame, percent: int = 85, size: int = 4, block: int = 512) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Two documents are linked if 100 * intersection >= percent * union of their sets of ``size``-word runs (fewer words
    are one run). Null texts and texts without words have an empty set and are linked with nothing. Repeated rows are
    copies of each other; rows with a null doc_id get the component of the copies that have one, but link nothing
    themselves. A doc_id that stands for several texts is one node with the links of all of them.
    """
    marked = written(profile(docs, size), "profiles")
    filled = marked.filter("set_key is not null and doc_id is not null")
    one = lambda c: F.any_value(c).alias(c)
    classes = written(filled.groupBy("set_key").agg(F.min("doc_id").alias("class"), one("short"), one("n"), one("excess"), one("bits"), one("counts")), "classes")
    found = links(docs.filter("doc_id is not null"), classes, percent, size, block)
    # several texts of one doc_id tie their classes together
    several = filled.groupBy("doc_id").agg(F.count_distinct("set_key").alias("k")).filter("k > 1").select("doc_id")
    ties = filled.join(several, "doc_id").join(classes.select("set_key", "class"), "set_key").select(F.col("doc_id").alias("a"), F.col("class").alias("b"))
    label = components(found.unionByName(ties)).withColumnRenamed("node", "class")
    named = classes.join(label, "class", "left").select("set_key", F.coalesce("label", "class").alias("component_id"))
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")]
    # rows without a set stay out of the join: they would all meet under one key
    bare = marked.filter("set_key is null").withColumn("component_id", F.col("doc_id"))
    return marked.filter("set_key is not null").join(named, "set_key", "left").select(*columns).unionByName(bare.select(*columns))
