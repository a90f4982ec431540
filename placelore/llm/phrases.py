"""Collocations by sampled mining: a sample proposes phrases, full passes count them and their negative border exactly.

A phrase is proposed if a sample of the documents holds it often enough for its share. The proposed set is a bit field of
fixed size over phrase hashes, so it can be sent to every task whatever the corpus; a false bit only makes one more phrase
be counted. The negative border is made of the phrases that are not proposed while both of their parts, without the last
and without the first word, are (every single word is in it or proposed).

A full pass counts proposed phrases by their words and border phrases by their hash. A border hash that reaches the
wanted count is a failure of the sample: it joins the proposed set, and a further pass counts what this adds - the
phrases themselves and those that the larger set brings into reach. Without failures the set is closed: a frequent phrase
has only frequent parts, so it was proposed, or in the border and would have failed. As failures of one pass are longer
than those of the pass before, there are at most as many passes as a phrase may have words, and one more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from placelore.llm.common import slices, written
from placelore.llm.superminhash import BASE, mix

#: Ends of pieces, then blanks; ends become a word of their own, which no text can hold.
TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b".........." + b" ")
FIELD_BITS = 26
#: Words of text that a task counts together before it hands them on.
CHUNK = 1 << 19


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))


def tokens(text: bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased; the end of a piece is the word ``.``, and so is the end of the text."""
    return [*(text or b"").lower().translate(TABLE).replace(b".", b" . ").split(), b"."]


class Chunk:
    """The words of many texts with their languages, and the hashes of their phrases."""

    def __init__(self):
        self.words: list[bytes] = []
        self.langs: list[tuple[str, int]] = []

    def add(self, lang: str, text: bytes | None) -> None:
        words = tokens(text)
        self.words += words
        if self.langs and self.langs[-1][0] == lang:
            self.langs[-1] = (lang, self.langs[-1][1] + len(words))
        else:
            self.langs.append((lang, len(words)))

    def grams(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: (length, positions where a phrase of it starts, hashes at all positions)."""
        words = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))  # quicker than to number them
        end = words == np.uint64(xxhash.xxh64_intdigest(b"."))
        names = sorted({lang for lang, _ in self.langs})
        number = {lang: i for i, lang in enumerate(names)}
        self.names, self.lang = names, np.repeat([number[lang] for lang, _ in self.langs], [n for _, n in self.langs])
        seed = np.array([xxhash.xxh64_intdigest(lang.encode(), 1) for lang in names], np.uint64)[self.lang]
        place = np.arange(len(words))
        ahead = np.minimum.accumulate(np.where(end, place, len(words))[::-1])[::-1] - place  # words left in the piece
        total = seed
        with np.errstate(over="ignore"):
            for k in range(1, longest + 1):
                total = mix(total[: len(words) - k + 1] * BASE + words[k - 1:]) if len(words) >= k else total[:0]
                yield k, np.flatnonzero(ahead[: len(total)] >= k), total


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    chunk = Chunk()
    for batch in slices(batches, "text"):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            chunk.add(lang, text)
        if len(chunk.words) >= CHUNK:
            yield chunk
            chunk = Chunk()
    if chunk.words:
        yield chunk


def sampled(docs: DataFrame, share: int) -> DataFrame:
    """One document in ``share``, by a hash of its id and text."""
    return docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0)


def hash_counts(docs: DataFrame, longest: int) -> DataFrame:
    """(h, n) of all phrases of up to ``longest`` words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            for _, at, total in chunk.grams(longest):
                h, n = np.unique(total[at], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return _rows(docs).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each hash in the bit field."""
    mask = np.uint64((1 << FIELD_BITS) - 1)
    return (h & mask).astype(np.int64), (mix(h) & mask).astype(np.int64)


def field_of(hashes: DataFrame) -> np.ndarray:
    """The bit field of the column h, as bytes; its parts are combined by Spark, so its size bounds what is collected."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FIELD_BITS, bool)
        for batch in batches:
            for at in slots(batch.column("h").to_numpy().view(np.uint64)):
                bits[at] = True
        packed = np.packbits(bits, bitorder="little").view("<i8")
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(packed[at])], names=["i", "bits"])

    parts = hashes.select("h").mapInArrow(run, "i int, bits long").groupBy("i").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros((1 << FIELD_BITS) // 64, "<i8")
    out[parts.column("i").to_numpy()] = parts.column("bits").to_numpy()
    return out.view(np.uint8)


def inside(field: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes have both of their bits; the second is looked up only where the first is there."""
    one = (h & np.uint64((1 << FIELD_BITS) - 1)).astype(np.int64)
    out = (field[one >> 3] >> (one & 7).astype(np.uint8) & 1).astype(bool)
    at = np.flatnonzero(out)
    two = slots(h[at])[1]
    out[at] = (field[two >> 3] >> (two & 7).astype(np.uint8) & 1).astype(bool)
    return out


def held(field: np.ndarray, reach: np.ndarray, at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For all positions: proposed, and both parts proposed (``reach`` marks the positions ``at``)."""
    out = np.zeros(len(h) + 1, bool)  # one more, so that the position after the last can be asked for
    in_reach = at[reach]
    out[in_reach] = inside(field, h[in_reach])
    return out


def full_pass(docs: DataFrame, longest: int, field: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """(phrase, h, n): proposed phrases as length, words and language, border phrases with their hash alone.

    With ``before``, the field of the last pass, only what the larger field adds is counted: phrases whose parts have
    become proposed, and proposed phrases that were in the border. The phrase of length 0 has the number of words.
    """
    sent = docs.sparkSession.sparkContext.broadcast((field, before))

    def out(phrases: list | None, h: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.string()) if phrases is None else pa.array(phrases, pa.string()), pa.nulls(len(n), pa.int64()) if h is None else pa.array(h.view(np.int64)), pa.array(n)], names=["phrase", "h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, before = sent.value
        for chunk in chunks(batches):
            now = then = None
            for k, at, total in chunk.grams(longest):
                reach = np.ones(len(at), bool) if k == 1 else now[at] & now[at + 1]
                now_k = held(field, reach, at, total)
                if before is None:
                    if k == 1:
                        yield out([f"0\t\t{lang}" for lang in chunk.names], None, np.bincount(chunk.lang[at], minlength=len(chunk.names)))
                    new = reach
                else:
                    old = np.ones(len(at), bool) if k == 1 else then[at] & then[at + 1]
                    then = held(before, old, at, total)
                    new = reach & (~old | (now_k[at] & ~then[at]))
                now, at = now_k, at[new]
                if not len(at):
                    continue
                member = now[at]
                h, n = np.unique(total[at[~member]], return_counts=True)
                if len(h):
                    yield out(None, h, n)
                h, first, n = np.unique(total[at[member]], return_index=True, return_counts=True)
                start = at[member][first].tolist()
                if start:
                    text = [b" ".join(chunk.words[i:i + k]).decode("utf-8", "replace") for i in start]
                    yield out([f"{k}\t{t}\t{chunk.names[j]}" for t, j in zip(text, chunk.lang[start].tolist())], None, n)

    return _rows(docs).mapInArrow(run, "phrase string, h long, n long").groupBy("phrase", "h").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, share: int = 16, lowered: float = 0.6) -> DataFrame:
    """(lang, size, phrase, n) of all phrases of 1 to ``longest`` words with n >= least, and the words of each lang as size 0.

    Counts are exact and cover all documents; ``share`` (the sample's) and ``lowered`` (the part of its expected count at
    which a phrase is proposed) decide only how many passes are needed. Null texts are empty, a null lang is ``und``.
    """
    seeds = hash_counts(sampled(docs, share), longest).filter(F.col("n") >= max(2, int(lowered * least / share)))
    field, before, passes = field_of(seeds), None, []
    while True:
        # infrequent counts are no longer needed once their sum is known
        counted = written(full_pass(docs, longest, field, before).filter((F.col("n") >= least) | F.col("phrase").startswith("0\t")), "counted")
        passes.append(counted.filter("phrase is not null").select("phrase", "n"))
        failed = counted.filter("phrase is null")
        if failed.isEmpty():
            break
        before, field = field, field | field_of(failed)
    out = passes[0]
    for rows in passes[1:]:
        out = out.unionByName(rows)
    part = lambda i: F.regexp_extract("phrase", r"(?s)^(\d+)\t([^\t]*)\t(.*)$", i)
    return out.groupBy("phrase").agg(F.max("n").alias("n")).select(part(3).alias("lang"), part(1).cast("int").alias("size"), part(2).alias("phrase"), "n")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, most: int = 2000, percent: int = 100, share: int = 16) -> DataFrame:
    """The first ``most`` collocations of each lang of ``docs`` (doc_id, text, lang): lang, rank, phrase, a, l, r, n, score.

    Cutting a phrase after k words gives l and r, the counts of its two parts, and floor(1000 * a * n / (l * r)); the
    lowest-scoring cut counts, ties to the smallest k. A phrase goes if a longer one that holds it has at least
    ``percent`` hundredths of its count. Ranks: score and a descending, then the phrase in byte order.
    """
    counted = written(frequent_phrases(docs, least, longest, share), "frequent")
    words = counted.filter("size = 0").select("lang", F.col("n").alias("n"))
    part = counted.filter("size > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("count"))
    found = counted.filter("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = found.select("lang", "phrase", "size", "a", "w", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"))
    cuts = (cuts.join(part.select("lang", F.col("part").alias("left"), F.col("count").alias("l")), ["lang", "left"])
            .join(part.select("lang", F.col("part").alias("right"), F.col("count").alias("r")), ["lang", "right"]).join(words, "lang"))
    # decimals of 38 digits: neither product can pass them while counts stay under 10^17
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(17,0)) * cast(r as decimal(17,0)))")
    best = cuts.select("lang", "phrase", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min("cut").alias("cut"))
    spans = F.expr("flatten(transform(sequence(2, size - 1), s -> transform(sequence(1, size - s + 1), i -> array_join(slice(w, i, s), ' '))))")
    held = found.filter("size > 2").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(held, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    top = kept.withColumn("rank", rank).filter(F.col("rank") <= most)
    return top.select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
