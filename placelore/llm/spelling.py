"""Spelling variants: words one edit apart, found by moving a frontier of states through a trie held as a table.

The trie is an edge table (node, label, child, terminal); a node is the prefix it stands for, so nothing is hashed. Labels
are single letters down to a depth of 32 and double in length after it, which keeps the number of levels small for very
long words. Every word walks down its own path without an edit; from the nodes of that path a state may step once to a
child whose label differs by one replaced letter or has one letter more, and then goes on only along equal labels. A state
whose word is used up at a terminal node is a neighbour.

Where the edit is in the first half of a word, the same walk on the reversed words finds it in the second half. So states
leave their path only below half of the word, where nodes have few children, and the frontier stays a small multiple of
the vocabulary. One level is one join on the node; the states after it are a written table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelore.llm.common import scratch, slices, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SINGLE = 32
DROPPED = 199


def run_counts(docs: DataFrame, least: int = 6, dropped: int = DROPPED, keep: int = 100_000) -> DataFrame:
    """(word, n): occurrences of runs of Latin-1 letters, A-Z lower-cased, with at least ``least`` letters.

    With h the crc32 of ``<doc_id>:<run>`` (a null doc_id is empty), runs with h divisible by ``dropped`` lose the letter
    at h % length. Null texts have no runs; a task holds at most about ``keep`` words before it hands them on.
    """
    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches, "text"):
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                lead = zlib.crc32(f"{name or ''}:".encode())
                for word, n in Counter(RUN.findall(text.lower().decode("utf-8", "replace"))).items():
                    if len(word) < least:
                        continue
                    h = zlib.crc32(word.encode(), lead)
                    if h % dropped == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least:
                            continue
                    counts[word] += n
            if len(counts) > keep:
                yield out(counts)
                counts = Counter()
        yield out(counts)

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def depths(longest: int) -> list[int]:
    """Depths at which nodes stand, the last not below ``longest``."""
    at = list(range(SINGLE + 1))
    while at[-1] < longest:
        at.append(2 * at[-1])
    return at


def below(depth):
    """The depth under a depth."""
    return F.when(depth < SINGLE, depth + 1).otherwise(2 * depth)


def level_of(length):
    """The deepest depth not below ``length``; one level less deep would only be slower."""
    return F.when(length <= SINGLE, length).otherwise(F.pow(F.lit(2), F.floor(F.log2(F.greatest(length, F.lit(1))))).cast("int"))


def neighbours(words: DataFrame) -> DataFrame:
    """All ordered pairs (word, near) of distinct values of ``words.word`` that differ by exactly one edit.

    Null and empty words have no neighbours; repeated words count once.
    """
    spark = words.sparkSession
    known = words.filter("word is not null and word <> ''").select("word").distinct()
    size = F.char_length("spelled")
    both = known.select(F.lit(0).alias("side"), F.col("word").alias("spelled")).unionByName(known.select(F.lit(1).alias("side"), F.reverse("word").alias("spelled")))
    half = F.floor(size / 2).cast("int")
    both = both.select("*", size.alias("size"), level_of(F.when(F.col("side") == 0, half).otherwise(size - half)).alias("start"))
    spelled = written(both, "spelled")
    first, longest = spelled.agg(F.min("start"), F.max("size")).first()
    if longest is None:
        return known.select("word", F.col("word").alias("near")).limit(0)
    at = depths(longest)
    steps = spelled.select("side", "spelled", "size", F.explode(F.filter(F.lit(at).cast("array<int>"), lambda p: (p >= first) & (p < F.col("size")))).alias("depth"))
    piece = F.least(below(F.col("depth")), F.col("size")) - F.col("depth")
    edges = (steps.select("depth", "side", F.expr("left(spelled, depth)").alias("node"), F.substring("spelled", F.col("depth") + 1, piece).alias("label"), (F.col("depth") + piece == F.col("size")).alias("ends"))
             .groupBy("depth", "side", "node", "label").agg(F.max("ends").alias("terminal")))
    trie, folder = scratch(spark, "trie"), scratch(spark, "states")
    edges.write.partitionBy("depth").parquet(trie)
    edges = spark.read.schema(edges.schema).parquet(trie)  # a level reads its own folder
    state = "spelled string, side int, node string, shift int, edits int, done boolean"
    frontier = spark.createDataFrame([], state)
    label, wide = F.col("label"), F.char_length("label")
    for depth in [p for p in at if p >= first]:
        own = spelled.filter((F.col("start") <= depth) & (F.col("size") >= depth)).select(
            "spelled", "side", F.expr(f"left(spelled, {depth})").alias("node"), F.lit(0).alias("shift"), F.lit(0).alias("edits"))
        states = own.unionByName(frontier.drop("done"))
        met = states.join(edges.filter(F.col("depth") == depth).drop("depth"), ["side", "node"])
        rest = lambda k: F.substring("spelled", F.lit(depth + 1) + F.col("shift"), k)
        equal = (F.col("edits") == 1) & (rest(wide) == label)
        # of two words that differ by a replaced letter the smaller one looks for the larger
        replaced = (F.col("edits") == 0) & (F.char_length(rest(wide)) == wide) & (rest(wide) < label) & (F.levenshtein(rest(wide), label, 1) == 1)
        # a letter more before an equal one is the same as one after it, where it is found as well
        apart = rest(wide) != label if depth < SINGLE else F.lit(True)
        longer = (F.col("edits") == 0) & apart & (F.char_length(rest(wide - 1)) == wide - 1) & (F.levenshtein(rest(wide - 1), label, 1) == 1)
        moves = F.filter(F.array(F.when(equal, F.col("shift")), F.when(replaced, F.lit(0)), F.when(longer, F.lit(-1))), lambda x: x.isNotNull())
        moved = met.select("spelled", "side", F.concat("node", "label").alias("node"), F.explode(moves).alias("shift"), F.lit(1).alias("edits"), "terminal")
        ends = F.char_length("node") + F.col("shift") == size
        moved = moved.select("spelled", "side", "node", "shift", "edits", ends.alias("done")).filter(~ends | F.col("terminal"))
        moved.write.parquet(f"{folder}/{depth}")
        frontier = spark.read.schema(state).parquet(f"{folder}/{depth}").filter("not done")
    found = spark.read.schema(state).parquet(*[f"{folder}/{p}" for p in at if p >= first]).filter("done")
    turned = lambda c: F.when(F.col("side") == 0, F.col(c)).otherwise(F.reverse(c))
    pairs = found.select(turned("spelled").alias("word"), turned("node").alias("near"))
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last word reached by following forms, which must not run in a circle."""
    links = written(forms.filter("form is not null").select("word", F.col("form").alias("root")), "links")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = written(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        links = ahead.drop("moved")
        if ahead.filter("moved").isEmpty():
            return links


def variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """Per word of ``words`` (word, n): word, form, root, n, n_near, form_n.

    A word's form is its neighbour of largest n (ties: the smallest in code-point order) if that n >= factor * its own,
    else null; n grows along forms, so they never run in a circle. Words must be distinct; nulls have been left out.
    """
    n = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = neighbours(words).join(n, "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    led = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.less") >= factor * F.col("n"), F.col("best")).alias("best"))
    led = written(led.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")), "forms")
    return led.join(roots(led), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_spellings(docs: DataFrame, least: int = 6, min_count: int = 5, factor: int = 5, dropped: int = DROPPED) -> DataFrame:
    """Spelling variants of the words of ``docs`` (doc_id, text) that occur at least ``min_count`` times."""
    return variants(written(run_counts(docs, least, dropped).filter(F.col("n") >= min_count), "words"), factor)
