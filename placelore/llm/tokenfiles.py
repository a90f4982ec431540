"""Token-id files: flat unsigned integers and 64-bit offsets, memory-mapped when read.

Documents are sorted by id over range partitions; each task writes one set of files and one manifest row. The manifest
names only the files of tasks that ended, so a repeated or speculative task leaves files that nobody reads. The first
token of a file in the whole corpus is the prefix sum of the manifest's counts.

Files of a part, all little-endian: ``.ids`` token ids (2 bytes each when the vocabulary has up to 65,536 ids, else 4),
``.offsets`` n + 1 unsigned 64-bit positions of documents in it, ``.docs`` signed 64-bit document ids (0 for null ids,
which come first; the manifest has their number).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from placelore.llm.common import crc, encoder, slices, written

MANIFEST = "part int, path string, width int, n_docs long, n_null long, n_tokens long"


def mounted(uri: str) -> str:
    """The path of a shared folder that is mounted on every machine; memory-mapping needs one."""
    at = urlparse(uri)
    if at.scheme not in ("", "file"):
        raise ValueError(f"files are written and mapped through a mounted shared folder, not {uri}")
    return unquote(at.path)


def put(path: str, data: bytes) -> None:
    """Write under a name of its own, then rename, so that a name never shows half a file."""
    with open(f"{path}.part", "wb") as f:
        f.write(data)
    os.replace(f"{path}.part", path)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write all documents (doc_id, text) in ascending doc_id order, equal ids by text; null ids first, null text empty.

    Returns the manifest, one row per part, itself a written table.
    """
    folder = mounted(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        top = max(enc.tokenizer.get_vocab_size() - 1, end_id)
        kind = np.dtype("<u2" if top < 1 << 16 else "<u4")
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, f"part-{part:06d}-{uuid.uuid4().hex}")
        lengths, ids_of_docs, nulls = [], [], 0
        with open(f"{path}.ids.part", "wb") as out:
            for batch in slices(batches, "text"):
                for ids in enc.encode([t or "" for t in batch.column("text").to_pylist()]):
                    all_ids = np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id))
                    out.write(all_ids.astype(kind).tobytes())
                    lengths.append(len(all_ids))
                nulls += batch.column("doc_id").null_count
                ids_of_docs.append(batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        if not lengths:
            os.remove(f"{path}.ids.part")
            return
        os.replace(f"{path}.ids.part", f"{path}.ids")
        put(f"{path}.offsets", np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes())
        put(f"{path}.docs", np.concatenate(ids_of_docs).tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "width": pa.array([kind.itemsize], pa.int32()),
                                          "n_docs": [len(lengths)], "n_null": [nulls], "n_tokens": [sum(lengths)]})

    # ranges are found from a sample of the ids alone; rows of one id share a range
    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ranged.mapInArrow(write, MANIFEST), "manifest")


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest with ``base``, the tokens in all parts before. One row per file, so the window is small."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, batch_docs: int = 20_000) -> DataFrame:
    """Documents as the mapped files hold them: doc_id, start, n_tokens, ids_crc32 (of unsigned 32-bit ids)."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            ids = np.memmap(f"{row['path']}.ids", f"<u{row['width']}", "r")
            offsets = np.memmap(f"{row['path']}.offsets", "<u8", "r").astype(np.int64)
            names = np.memmap(f"{row['path']}.docs", "<i8", "r")
            assert len(ids) == offsets[-1] == row["n_tokens"] and len(names) == row["n_docs"], f"{row['path']} does not match its manifest row"
            for lo in range(0, len(names), batch_docs):
                at = offsets[lo:lo + batch_docs + 1]
                crcs = [crc(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                null = np.arange(lo, lo + len(crcs)) < row["n_null"]
                yield pa.RecordBatch.from_arrays([pa.array(names[lo:lo + batch_docs], mask=null), pa.array(row["base"] + at[:-1]), pa.array(np.diff(at)),
                                                  pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.count()
    spread = with_bases(manifest).repartition(max(1, min(files, 10_000)), "part")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
