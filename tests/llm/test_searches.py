import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placelore.llm import decontaminate, tokenfiles, topk, viterbi
from placelore.llm.common import ChunkEncoder, scratch

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def plain_top(rows, k):
    valid = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in sorted({i: min(w for j, w in valid if j == i) for i, _ in valid if i % 20 == 0}.items()):
        best = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in valid if i != q and len(w) == len(v)))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return out


def test_top_k_against_all_scores(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=24).round(2).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(60)]  # many equal vectors: ties
    rows += [(400, [float("nan")] * 24), (401, None), (402, [None] + [1.0] * 23), (403, []), (404, [float("inf")] + [0.0] * 23), (None, [1.0] * 24), (420, [1.0, 2.0]), (421, [3.0, -1.0]), (440, [5.0]), (40, rows[40][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=20, query_rows=5, block_rows=64, step=8)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == plain_top(rows, 20)


def test_top_k_beyond_exact_floats():
    big = np.array([[1 << 30, 1 << 30], [(1 << 30) - 1, (1 << 30) + 1], [1 << 30, (1 << 30) + 1]], np.int64)
    found = topk.search(np.array([9]), big[:1], np.array([1, 2, 3]), np.ascontiguousarray(big.T), 3, 1)
    exact = sorted(((-sum(int(a) * int(b) for a, b in zip(big[0], v)), i) for i, v in enumerate(big.tolist(), 1)))
    assert list(zip(found[1], found[2])) == [(i, -s) for s, i in exact]


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect() == []


def plain_hits(text, items, size):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    words = word.findall(low(text))
    hit, names = [False] * len(words), set()
    for item, t in items:
        w = word.findall(low(t))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            part = w[i:i + size]
            for j in range(len(words) - len(part) + 1):
                if words[j:j + len(part)] == part:
                    hit[j:j + len(part)] = [True] * len(part)
                    names |= {str(item)} - {"None"}
    return len(words), sum(hit), sorted(names)


DOCS = [(1, "The cat, sat ON the mat; and then it left."), (2, None), (3, ""), (4, "!!! ..."), (5, "cat sat on the mat and then it"), (6, "É è ça c'est bien é"), (7, "on the on the on the on the"), (8, "xcat sat on the matx"),
        (9, "short item here Short-Item"), (1, "The cat, sat ON the mat; and then it left."), (None, "cat sat on the mat"), (10, "a " * 30_000 + "cat sat on the mat")]
ITEMS = [(1, "cat sat on the mat and"), (10, "on the on"), (2, "short item"), (3, None), (4, "?!"), (None, "é è ça"), (1, "cat sat on the mat and"), (7, "È É")]


def test_decontamination_against_plain_search(spark):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in DOCS], "doc_id long, text string, n_hit int, items string")
    bench = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, doc_id int")
    for most in (1, 1000):
        found = decontaminate.find(docs, bench, size=4, max_windows=most)
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in found.collect()}
        assert got == {d: plain_hits(t, ITEMS, 4) for d, t in DOCS}
    spans = {r.doc_id: [DOCS[0][1][s.start:s.end] for s in r.spans] for r in found.collect() if r.doc_id == 1}
    assert spans == {1: ["cat, sat ON the mat; and"]}
    told = {r.doc_id: r for r in decontaminate.digest(found).collect()}
    assert told[2].items_sha256 == hashlib.sha256(b"").hexdigest() and told[7].items_sha256 == hashlib.sha256(b"10").hexdigest() and told[7].contaminated
    assert told[6].n_items == 0 and told[6].contaminated is False or told[6].n_hit > 0
    assert decontaminate.find(docs.limit(0), bench).collect() == []
    assert {r.n_hit for r in decontaminate.find(docs, bench.limit(0)).collect()} == {0}


def test_token_files_round_trip(spark):
    rows = [(5, "b b"), (3, "hello World"), (None, "no id"), (9, None), (7, ""), (3, "a"), (-4, "x " * 5000), (3, "a"), (None, None)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, start int").repartition(3)
    manifest = tokenfiles.write_token_files(docs, scratch(spark, "tokens"), WORD_BPE)
    files = manifest.collect()
    assert all(np.fromfile(f"{r.path}.ids", "<u2").size == r.n_tokens and np.fromfile(f"{r.path}.offsets", "<u8")[-1] == r.n_tokens for r in files)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfiles.read_token_files(manifest, batch_docs=2).collect())
    e, want, at = ChunkEncoder(WORD_BPE), [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = e.ids([t or ""])[0] + b"\1\0\0\0"
        want.append((at, d, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert got == want
    assert tokenfiles.read_token_files(tokenfiles.write_token_files(docs.limit(0), scratch(spark, "tokens"), WORD_BPE)).collect() == []


PATH = public_tokenizers.path("piece_bpe_32k.model")
COUNTER = viterbi.Counter(viterbi.vocabulary(PATH), keep=100)


def reference(pieces, unknown=0):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(pieces, unknown, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    return t


WHOLE = reference(viterbi.vocabulary(PATH))
SMALL = [("<unk>", 0.0), *[(f"<0x{i:02X}>", -20.0) for i in range(256)], ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("ba", -3.5), ("aba", -5.5), ("▁", -1.0), ("▁a", -3.0), ("abab", -8.0), ("▁ab", -5.0)]
TIES = reference(SMALL), viterbi.Counter(SMALL)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(["the ", "token", " ", "\n", "▁", "é́", "日本", "😀", "<s>", "<0x0A>", "ing"])).map("".join)))
def test_counts_are_those_of_the_tokenizer(text):
    assert COUNTER.count(text)[0] == len(WHOLE.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text("ab ▁c", max_size=14))
def test_ties_go_as_in_the_tokenizer(text):
    assert TIES[1].count(text)[0] == len(TIES[0].encode(text, add_special_tokens=False).ids)


def test_count_table(spark):
    rows = [(1, "hello world"), (2, None), (3, ""), (1, "hello world"), (None, "x"), (4, "y" * 100_000)]
    got = viterbi.count_tokens(spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_tokens int"), PATH).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.n_tokens) for r in got) == sorted((str(d), len(t or ""), len(WHOLE.encode(t or "", add_special_tokens=False).ids)) for d, t in rows)
    assert viterbi.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
