import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from placelore.llm.common import ChunkEncoder
from placelore.llm.packing import pack, pack_documents, plan, token_pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, length long, offset string"
ENCODERS = {name: ChunkEncoder(public_tokenizers.path(name), keep=50) for name in ("byte_bpe_50k.json", "word_bpe_49k.json")}
WORDS = st.lists(st.sampled_from(["the", " ", "\n", "  ", "\t", "it's", "É", "é́", "́", "x,", "ªµß", "Ünï", "x***", "a.'", "...", "<|endoftext|>", "\x01", "12", "日本", " ", "ﬁ", "'s", "İ"]), max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(WORDS.map("".join), st.text(max_size=20)), max_size=4))
def test_chunks_encode_as_whole_texts(texts):
    for e in ENCODERS.values():
        assert e.encode(texts) == e.ids(texts)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [{}, {"max_documents": 3}, {"max_cost": 3000}, {"max_documents": 2, "max_cost": 5000}])
def test_plan_keeps_every_capacity(rule, limits):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 51, 500)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    rows = plan(counts, capacity=64, rule=rule, **limits)
    bins, seen = {}, {}
    for length, lo, hi, first, copies, offset in rows:
        assert lo == seen.get(length, 0)
        seen[length] = hi
        for r in range(lo, hi):
            bins.setdefault(first + (r - lo) // copies, []).append((offset + (r - lo) % copies * length, length))
    assert seen == counts
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64 and len(items) <= limits.get("max_documents", 10**9) and sum(n * n for _, n in items) <= limits.get("max_cost", 64 * 64)
    if not limits and rule == "norm":
        assert len(bins) <= -(-int(lengths.sum()) // 64) + 1


def test_plan_refuses_what_fits_nowhere():
    with pytest.raises(ValueError):
        plan({70: 1}, capacity=64)
    assert plan({}) == []


def test_documents_are_whole_and_gapless(spark):
    texts = ["a b c", None, "", "a b c", "word " * 300, "the " * 64, "x"]
    docs = spark.createDataFrame([(i, t, 7, "clash") for i, t in enumerate(texts)] + [(3, "a b c", 7, "clash"), (None, "a", 7, "clash")], SCHEMA)
    rows = pack_documents(docs.repartition(3), PATH, capacity=32).collect()
    e = ENCODERS["byte_bpe_50k.json"]
    want = []
    for i, t in [*enumerate(texts), (3, "a b c"), (None, "a")]:
        ids = e.ids([t or ""])[0] + b"\0\0\0\0"
        n, lo, size, piece = len(ids) // 4, 0, (len(ids) // 4 - 1) % 32 + 1, 0
        while lo < n:
            want.append((i, piece, lo, size, zlib.crc32(ids[4 * lo:4 * (lo + size)])))
            lo, size, piece = lo + size, 32, piece + 1
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted([tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows], key=key) == sorted(want, key=key)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 32
    assert len(bins) == -(-sum(r.length for r in rows) // 32)


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_one_length_holds_most_rows(spark):
    docs = spark.createDataFrame([(i, "same text here", 0, "") for i in range(400)], SCHEMA).repartition(4)
    rows = pack(token_pieces(docs, PATH, 16), 16).collect()
    size = rows[0].length
    assert len({(r.sequence_id, r.offset) for r in rows}) == 400 and len({r.sequence_id for r in rows}) == -(-400 // (16 // size))


def test_encoder_lets_go_of_its_chunks():
    """The pipeline's workers kept some 65 MB of chunks each beside its other stages."""
    import public_tokenizers

    from placelore.llm.common import ChunkEncoder

    enc = ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Some words, and some more words.", "café 42!"]
    first = enc.encode(texts)
    assert len(enc.now) > 5
    enc.forget()
    assert not enc.now and not enc.old and not enc.ends
    assert enc.encode(texts) == first
