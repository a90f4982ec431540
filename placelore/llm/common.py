"""Shared helpers: tables written to the shared folder, record batches in bounded slices, token encoding by cached chunks."""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from placelore.session import shared_dir

SLICE_BYTES = 1 << 20
#: For filters and scores, whose arrays take about eighty bytes per byte of text: workers of all stages share an executor's memory.
JUDGED_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there, so a lost executor repeats no earlier stage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``size`` bytes in each; a longer single value stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cut = np.cumsum(sizes) // size
        edges = np.flatnonzero(np.diff(cut)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            yield batch.slice(lo, hi - lo)


def fold(text: Column | str):
    """The text as bytes with A-Z lower-cased, null as empty; other letters stay."""
    return F.encode(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "UTF-8")


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the documents that no model may learn from; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def keep_rows(docs: DataFrame, judge: Callable[[list[str | None]], np.ndarray]) -> DataFrame:
    """The rows, with all their columns, whose text ``judge`` marks as true; nothing is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", JUDGED_BYTES):
            yield batch.filter(pa.array(judge(batch.column("text").to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def first_of_each(rows: DataFrame, key: str, name: str, most: int) -> DataFrame:
    """Up to ``most`` rows of each value of ``key``, those with the smallest hash of ``name``.

    A value with many rows is first thinned by the hash to about twice as many, so that they do not all meet in one task.
    ``key`` must have few values: their counts are broadcast.
    """
    n = rows.groupBy(key).agg(F.count("*").alias("_n"))
    hashed = F.xxhash64(name)
    thin = rows.join(F.broadcast(n), key).filter(F.pmod(hashed, F.lit(1 << 30)) * F.col("_n") < F.lit((2 * most + 100) * (1 << 30)))
    nth = F.row_number().over(W.partitionBy(key).orderBy(hashed, name))
    return thin.withColumn("_nth", nth).filter(F.col("_nth") <= most).drop("_n", "_nth")


class Made(dict):
    """Values made by a function of their key when they are first asked for."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class ChunkEncoder:
    """Exact ids of a public tokenizer for whole texts, put together from encoded chunks that are kept.

    A byte-level vocabulary never joins a black character with a blank after it, so a text can be cut before every
    single blank and around every single line end; a word vocabulary that drops white space can be cut at every blank.
    Chunks repeat within a corpus, so most are looked up. New chunks of Latin-1 letters go straight to the vocabulary's
    merges, marks after them are looked up by themselves, and all others take the tokenizer's whole path. A text in
    which a cut would touch more white space is encoded whole. ``keep`` bounds the kept chunks: when it is reached,
    those not used lately are let go.
    """

    LATIN = "\u0100"
    #: Latin-1 letters, after a blank or not, and marks that follow them.
    SHAPE = re.compile(r"( ?[A-Za-z\u00AA\u00B5\u00BA\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!#$%&*,\-./:;=?@^_|~)\]}>]*)")

    def __init__(self, path: str, keep: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.drops_blanks = self.tokenizer.normalizer is not None
        self.keep, self.now, self.old = keep, Made(self.made), {}
        self.ends = Made(lambda mark: self.ids([mark])[0])
        self.model = self.tokenizer.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(i) for i in range(ord(" "), ord(self.LATIN)) if i == 32 or chr(i).isalpha()]
        self.shown = {ord(c): level.pre_tokenize_str(c)[0][0] for c in letters}
        resize = getattr(self.model, "_resize_cache", None)
        if resize:  # what comes here is new, so the model's own cache never helps
            resize(16)

    def forget(self) -> None:
        """Let go of all kept chunks: a worker lives on after its task, beside those of later stages."""
        self.now, self.old = Made(self.made), {}
        self.ends.clear()

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def chunks(self, text: str) -> list[str]:
        if self.drops_blanks:
            return text.replace("\n", " ").split(" ")
        return text.replace(" ", "\1 ").replace("\n", "\1\n\1").split("\1")

    def regular(self, chunk: str) -> bool:
        if self.drops_blanks or chunk == "\n":
            return True
        body = chunk[1:] if chunk[:1] == " " else chunk
        return bool(body) and not body[0].isspace() and not body[-1].isspace()

    def made(self, chunk: str) -> bytes | None:
        """Ids of a chunk that is not kept; None for one that must not stand alone."""
        if chunk in self.old:
            return self.old[chunk]
        found = self.SHAPE.fullmatch(chunk)
        if not found:
            return self.ids([chunk])[0] if self.regular(chunk) else None
        stem, mark = found.groups()
        if mark:
            return self.now[stem] + self.ends[mark]
        word = stem.lower() if self.drops_blanks else stem
        ids = [t.id for t in self.model.tokenize(word.translate(self.shown))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        get, out, whole = self.now.__getitem__, [], []
        for i, text in enumerate(texts):
            ids = None if text else b""
            if text and (self.drops_blanks or "\1" not in text):
                try:
                    ids = b"".join(map(get, self.chunks(text)))
                except TypeError:  # a chunk that must not stand alone
                    pass
            if ids is None:
                whole.append(i)
            out.append(ids)
            if len(self.now) > self.keep:
                self.old, self.now = self.now, Made(self.made)
                get = self.now.__getitem__
        for i, ids in zip(whole, self.ids([texts[i] for i in whole])):
            out[i] = ids
        if len(self.ends) > 10_000:
            self.ends.clear()
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> ChunkEncoder:
    """One per Python worker and vocabulary file."""
    return ChunkEncoder(path)


def crc(data) -> int:
    return zlib.crc32(data)
