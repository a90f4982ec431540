"""Registered queries of the dealt operators, and the SQL they are checked against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelore.llm import decontaminate, htmltree, langid, ngramjoin, packing, phrases, spelling, superminhash, tokenfiles, topk, toxicity, viterbi, warc
from placelore.llm.common import scratch, table

BYTE_BPE, WORD_BPE, PIECES = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op3_superminhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfiles.write_token_files(table(spark, sf_dir, "documents"), scratch(spark, "tokens"), public_tokenizers.path(WORD_BPE))
    return tokenfiles.read_token_files(manifest)


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).drop("languages")


def op10_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html_tree_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltree.main_text(table(spark, sf_dir, "pages"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_viterbi_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_pages(warc.write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc")))


def op11_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_join(table(spark, sf_dir, "documents"))


def op12_toivonen_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_trie_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_language_mixture, op3_superminhash_near_duplicates, op4_html_tree_main_text, op5_exact_top_k, op6_benchmark_decontamination, op7_token_files,
                                   op8_viterbi_token_counts, op9_warc_round_trip, op10_subword_toxicity, op11_signature_tree_join, op12_toivonen_collocations, op13_trie_spelling_variants)}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = f"""
with recursive w as (select doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(list_transform(generate_series(1, greatest(1, len(w) - 4)), lambda i: array_to_string(w[i:i + 4], ' '))) as s from w where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
e as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * i >= 85 * (x.n + y.n - i)),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on e.a = r.b),
c as (select a as doc_id, min(b) as component_id from r group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d left join n on n.doc_id = d.doc_id join c on c.doc_id = d.doc_id"""

OP11_SQL = f"""
with recursive w as (select doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(list_transform(generate_series(1, greatest(1, len(w) - 3)), lambda i: array_to_string(w[i:i + 3], ' '))) as s from w where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
e as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * i >= 85 * (x.n + y.n - i)),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on e.a = r.b),
c as (select a as doc_id, min(b) as component_id from r group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id from documents d left join n on n.doc_id = d.doc_id join c on c.doc_id = d.doc_id"""

OP12_SQL = f"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex({LOWER}, '[.,;:!?\\x0A-\\x0D]')) as p from documents),
w as (select lang, regexp_extract_all(p, '[^\\x20\\x09]+') as w from p),
n as (select lang, sum(len(w)) as n from w group by lang),
g as (select lang, k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(w[i:i + k - 1], ' '))) as g from w, (select unnest([1, 2, 3, 4, 5]) as k) where len(w) >= k),
f as (select lang, k, g, count(*) as f from g group by lang, k, g having count(*) >= 100),
x as (select f.lang, f.k, f.g, f.f as a, unnest(generate_series(1, f.k - 1)) as cut, string_split(f.g, ' ') as w from f where f.k > 1),
s as (select x.lang, x.k, x.g, x.a, x.cut, l.f as l, r.f as r, n.n, cast(floor(cast(1000 as hugeint) * x.a * cast(n.n as hugeint) // (cast(l.f as hugeint) * r.f)) as bigint) as score
      from x join n on n.lang = x.lang join f l on l.lang = x.lang and l.g = array_to_string(x.w[:x.cut], ' ') join f r on r.lang = x.lang and r.g = array_to_string(x.w[x.cut + 1:], ' ')),
b as (select * from (select *, row_number() over (partition by lang, g order by score, cut) as o from s) where o = 1),
z as (select lang, g, max(a) as longer from (select lang, k, a, unnest(flatten(list_transform(generate_series(2, k - 1), lambda s: list_transform(generate_series(1, k - s + 1), lambda i: array_to_string(string_split(g, ' ')[i:i + s - 1], ' '))))) as g from (select lang, k, g, f as a from f where k > 2)) group by lang, g),
t as (select b.*, row_number() over (partition by b.lang order by score desc, a desc, encode(b.g)) as rank from b left join z on z.lang = b.lang and z.g = b.g where z.longer is null or 100 * z.longer < 100 * b.a)
select lang, cast(rank as integer) as rank, g as phrase, a, l, r, cast(n as bigint) as n, score from t where rank <= 2000"""

OP5_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
           where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) as score
      from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
t as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from t where rank <= 20"""

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

OP6_SQL = f"""
with b as (select item_id, regexp_extract_all({LOWER}, '{WORD}') as w from benchmark),
k as (select distinct item_id, unnest(list_transform(generate_series(1, greatest(1, len(w) - 9)), lambda i: array_to_string(w[i:i + 9], ' '))) as k from b where len(w) > 0),
z as (select distinct k, len(string_split(k, ' ')) as size from k),
d as (select doc_id, regexp_extract_all({LOWER}, '{WORD}') as w from documents),
o as (select doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) as i from d cross join (select distinct size from z)),
m as (select o.doc_id, o.i, z.size, z.k from o join z on z.size = o.size and z.k = array_to_string(o.w[o.i:o.i + o.size - 1], ' ')),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + size - 1)) as p from m) group by doc_id),
t as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items from m join k on k.k = m.k group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h on h.doc_id = d.doc_id left join t on t.doc_id = d.doc_id"""

OP9_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest)
select p.page_id, p.payload_bytes, p.payload_digest, case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
       case when first <> page_id then first end as refers_to, true as verified
from p left join f on f.payload_digest = p.payload_digest"""

ORACLE: dict[str, str] = {"op3_superminhash_near_duplicates": OP3_SQL, "op5_exact_top_k": OP5_SQL, "op6_benchmark_decontamination": OP6_SQL, "op9_warc_round_trip": OP9_SQL,
                          "op11_signature_tree_join": OP11_SQL, "op12_toivonen_collocations": OP12_SQL}
