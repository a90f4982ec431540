"""Vocabulary reports and synonym resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from placelore.functions import normalize as N
from placelore.functions import rules as R
from placelore.functions import text as X


def unigrams(df: DataFrame, stop_words: list[str], text: str = "text", keep=()) -> DataFrame:
    return df.select(*keep, F.explode(X.tokens(F.col(text), stop_words)).alias("token"))


def bigram_rows(df: DataFrame, stop_words: list[str], text: str = "text", keep=()) -> DataFrame:
    toks = df.select(*keep, X.tokens(F.col(text), stop_words).alias("_t"))
    return toks.select(*keep, F.explode(X.bigrams(F.col("_t"))).alias("bigram"))


def coverage_report(notes: DataFrame, stop_words: list[str], top: int = 25, top_missed: int = 15) -> DataFrame:
    """Per category: tagged sentences, how many a rule covers, frequent words, frequent words of the missed ones.

    Each sentence is counted once per category it is tagged with; counts combine map-side before ranking.
    """
    sent = notes.select(F.explode(X.sentences(F.lower("text"))).alias("text"))
    tags = F.array(*[F.when(N.keyword_tag(F.col("text"), c),
                            F.struct(F.lit(c).alias("category"), N.rule_fires(F.col("text"), c).alias("covered")))
                     for c in R.CATEGORIES])
    rows = sent.select("text", F.inline(F.array_compact(tags)))
    # distinct sentences first: repeated text is tokenized once and weighted
    rows = rows.groupBy("text", "category", "covered").agg(F.count("*").alias("w"))
    totals = rows.groupBy("category").agg(F.sum("w").alias("sentences"), F.sum(F.when(F.col("covered"), F.col("w")).otherwise(0)).alias("covered"))
    head = totals.select("category", F.inline(F.array(
        F.struct(F.lit("sentences").alias("item"), F.col("sentences").alias("n")),
        F.struct(F.lit("covered").alias("item"), F.col("covered").alias("n")))))
    tok = unigrams(rows, stop_words, keep=("category", "covered", "w")).groupBy("category", "token").agg(
        F.sum("w").alias("n"), F.sum(F.when(~F.col("covered"), F.col("w")).otherwise(0)).alias("missed"))

    def ranked(count, n, prefix):
        w = W.partitionBy("category").orderBy(F.desc(count), "token")
        return (tok.filter(F.col(count) > 0).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
                .select("category", F.concat(F.lit(prefix), "token").alias("item"), F.col(count).alias("n")))

    return head.unionByName(ranked("n", top, "top:")).unionByName(ranked("missed", top_missed, "missed:"))


def resolve_synonyms(asked: DataFrame, synonyms: DataFrame, key: str) -> DataFrame:
    """``asked``: (key, pos, word); ``synonyms``: (word, term). Unknown words stand for themselves; a term is
    kept once per key, at its first position."""
    words = asked.withColumn("_w", F.lower(F.trim("word")))
    joined = words.join(synonyms.withColumnRenamed("word", "_w"), "_w", "left")
    return joined.withColumn("term", F.coalesce("term", "word")).groupBy(key, "term").agg(F.min("pos").alias("pos"))
