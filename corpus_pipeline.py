"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns what it keeps.

All stages but the last return the columns of ``documents``; a row goes only by the decision of its stage, and equal rows
share its fate. The last stage returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelore.llm import decontaminate, langid, packing, superminhash, toxicity
from placelore.llm.common import written, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents found toxic by a model trained on the labelled documents."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents most of whose words no learned language explains, and those without letters."""
    return langid.drop_unknown(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, that with the smallest doc_id; a null doc_id comes last.

    Rows are decided one by one, so texts that share a doc_id stay or go for themselves. Texts without words copy nothing.
    """
    numbered = written(docs.select(F.monotonically_increasing_id().alias("_row"), *docs.columns), "numbered")
    groups = superminhash.near_duplicates(numbered.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    placed = written(groups.join(numbered.select("_row", "doc_id"), "_row").select("component_id", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row").alias("place")), "places")
    best = placed.groupBy("component_id").agg(F.min("place").alias("best"), F.count("*").alias("n")).filter("n > 1").select("component_id", "best")
    copies = placed.join(best, "component_id").filter("place._row <> best._row").select("place._row")
    # one plan at every size: the copies grow with the corpus, so they are never broadcast
    return numbered.join(copies.hint("merge"), "_row", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens; no worker keeps encoded chunks beside other stages."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), forget=True)


STAGES = [("toxicity", toxicity_stage), ("language", language_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage), ("packing", packing_stage)]

#: The stages learn models and tokenize, which SQL cannot; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
