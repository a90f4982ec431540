"""Benchmark decontamination: one automaton over the word windows of all items, run once over each whole text.

Texts are folded to words on both sides (A-Z lower-cased; words are runs of 0-9, a-z and characters beyond ASCII) and
joined by single blanks, so a window of words is a string with blanks around it and the automaton cannot start or end
inside a word. The automaton is built per task from the broadcast windows; a benchmark with more windows than
``max_windows`` is cut into several automata that the texts pass one after the other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelore.llm.common import keep_rows, slices

#: Bytes that are not of a word become blanks; A-Z become a-z.
FOLD = bytes(32 if c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


def windows(text: str | None, size: int) -> set[bytes]:
    """Runs of ``size`` words; a shorter text is one window, a text without words none."""
    w = words(text)
    return {b" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def read_benchmark(benchmark: DataFrame, size: int, max_items: int) -> list[tuple[str | None, str]]:
    """The items on the driver, after their number has been checked: this side is to be a benchmark, not a corpus."""
    rows = benchmark.select(F.col("item_id").cast("string"), "text").filter("text is not null").limit(max_items + 1).collect()
    if len(rows) > max_items:
        raise ValueError(f"more than {max_items} benchmark items; raise max_items if they fit in memory")
    return [tuple(r) for r in rows]


def automata(items: list[tuple[str | None, str]], size: int, max_windows: int) -> list[tuple[list[bytes], list[list[str]]]]:
    """(windows, item ids of each) in blocks of ``max_windows``."""
    of: dict[bytes, set[str]] = {}
    for item, text in items:
        for w in windows(text, size):
            of.setdefault(w, set()).update([item] if item is not None else [])
    keys = sorted(of)
    return [(keys[i:i + max_windows], [sorted(of[k]) for k in keys[i:i + max_windows]]) for i in range(0, len(keys), max_windows)]


def build(block: list[bytes]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for i, w in enumerate(block):
        a.add_word(f" {w.decode('latin-1')} ", i)
    a.make_automaton()
    return a


def spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character ranges of the original text under runs of hit words."""
    at = [m.span() for m in WORD.finditer(text.translate(ASCII_LOWER))]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [(at[a][0], at[b - 1][1]) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def occurrences(machines: list[tuple], text: str | None) -> tuple[int, np.ndarray | None, set[str]]:
    """Number of words, which of them are hit (None if none is), and the ids of the items met."""
    w, hit, names = words(text), None, set()
    line = f" {b' '.join(w).decode('latin-1')} " if w else ""
    for machine, keys, of in machines:
        for end, k in machine.iter(line):
            if hit is None:
                hit, ends = np.zeros(len(w) + 1, np.int32), np.cumsum([len(x) + 1 for x in w])
            last = int(np.searchsorted(ends, end))  # the word that ends before this blank
            hit[last + 1] -= 1
            hit[last - keys[k].count(b" ")] += 1
            names.update(of[k])
    return len(w), None if hit is None else np.cumsum(hit[:-1]) > 0, names


def find(docs: DataFrame, benchmark: DataFrame, size: int = 10, max_items: int = 200_000, max_windows: int = 2_000_000) -> DataFrame:
    """Per document (doc_id, text): n_words, n_hit (words inside any occurrence of a window), items (ids of the items
    met, sorted as strings) and spans (start, end) of hit passages as character positions in the original text.

    Null and empty texts have no words. Items without text or words match nothing; an item without an id marks words
    but is not listed. Repeated rows give repeated results; repeated items count once per id.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(automata(read_benchmark(benchmark, size, max_items), size, max_windows))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = [(build(keys), keys, names) for keys, names in shared.value]
        for batch in slices(batches, "text"):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                n, covered, names = occurrences(machines, text)
                if covered is None:
                    rows.append((doc, n, 0, [], []))
                else:
                    rows.append((doc, n, int(covered.sum()), sorted(names), [{"start": a, "end": b} for a, b in spans(text, covered)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()),
                                             pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))], names=["doc_id", "n_words", "n_hit", "items", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    """The items of a document as a number and one SHA-256 of their comma-joined ids."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, max_items: int = 200_000, max_windows: int = 2_000_000) -> DataFrame:
    """The rows of ``docs``, with all columns, in which ``find`` has no hit."""
    shared = docs.sparkSession.sparkContext.broadcast(automata(read_benchmark(benchmark, size, max_items), size, max_windows))
    built: list = []  # in each task, when its first rows come

    def judge(texts):
        if not built:
            built.extend((build(keys), keys, names) for keys, names in shared.value)
        return [occurrences(built, t)[1] is None for t in texts]

    return keep_rows(docs, judge)
