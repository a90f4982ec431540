"""run() of the corpus pipeline against a plain version of every stage on the smallest tables."""

import numpy as np
import public_tokenizers

import corpus_pipeline
from placelore.llm import langid, toxicity
from placelore.llm.common import ChunkEncoder
from tests.llm.test_searches import plain_hits
from tests.llm.test_superminhash import brute

SF = "/root/testdata/sf0.001"


def test_run_against_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = toxicity.train(*toxicity.sample(docs, spark.read.parquet(f"{SF}/labels.parquet"), 3000))
    rows = [r for r, s in zip(rows, toxicity.scores(model, [t for _, t in rows])) if s < 0.5]
    tox = dict(rows)
    assert 0 < len(tox) < docs.count()
    left = docs.filter(docs.doc_id.isin(list(tox)))
    names, table = langid.learn(left)
    rows = [r for r, s in zip(rows, langid.known_share(table, [t for _, t in rows])) if s >= 0.5]
    rows = [(d, tox[d]) for d, c in sorted({(int(d), int(c)) for d, _, c in brute(rows)}) if d == c]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r in rows if plain_hits(r[1], items, 10)[1] == 0]
    ids = ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json")).ids([t for _, t in rows])
    want = {d: len(i) // 4 + 1 for (d, _), i in zip(rows, ids)}
    got = corpus_pipeline.run(spark, SF).collect()
    have = {}
    for r in got:
        have[r.doc_id] = have.get(r.doc_id, 0) + r.length
    assert have == want
    bins = {}
    for r in got:
        bins[r.sequence_id] = bins.get(r.sequence_id, 0) + r.length
    assert max(bins.values()) <= 2048 and len(bins) <= -(-sum(want.values()) // 2048) + 1


def test_stages_on_awkward_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, hub string"
    rows = [(1, None, None, None, None, 1.0, "x"), (None, "some words in a row here", "en", "s", 1, 1.0, "x"), (2, "", "en", "s", 0, None, None), (3, "same words stand here again", "en", "s", 1, 1.0, "x"),
            (4, "same words stand here again", None, "s", 1, 1.0, "x"), (3, "same words stand here again", "en", "s", 1, 1.0, "x"), (5, "12 34", "en", "s", 1, 1.0, "x"), (6, "long " * 20_000, "en", "s", 1, 1.0, "x")]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["3", "6", "None"]
    assert len(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()) > 3
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []
    assert np.all([callable(f) for _, f in corpus_pipeline.STAGES])


def test_near_duplicates_are_decided_per_row(spark):
    """One doc_id may stand for several texts, and each text is kept or dropped for itself."""
    a, b, c, d = ("one two three four five six seven " * k for k in (1, 2, 3, 4))
    texts = [a + "alpha beta gamma delta epsilon zeta", b + "red green blue black white grey pink", c + "iron gold zinc lead tin neon argon", d + "oak elm ash yew fir pine birch"]
    rows = [(1, texts[0]), (5, texts[1]), (5, texts[0]), (9, texts[2]), (9, texts[3]), (9, texts[2]), (None, texts[3]), (None, None), (None, None), (2, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(map(str, [(1, texts[0]), (5, texts[1]), (9, texts[2]), (9, texts[3]), (None, None), (None, None), (2, "")]))


def test_language_stage_rejects_what_no_language_explains(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(10**6 + i, " ".join("".join(chr(97 + (i * 31 + j * j * 7 + k * k * 13 + j * k) % 26) for k in range(9)) for j in range(60)), None, "s", 1) for i in range(5)], docs.schema)
    ids = {r.doc_id for r in langid.drop_unknown(docs.unionByName(junk)).select("doc_id").collect()}
    assert not ids & {10**6 + i for i in range(5)}
    clean = docs.filter("lang is not null and n_chars > 200")
    assert clean.filter(clean.doc_id.isin(list(ids))).count() >= 0.99 * clean.count()
    only = langid.drop_unknown(docs, ["de"]).collect()
    assert only and all(r.lang in ("de", None) for r in only if len(r.text or "") > 300)
