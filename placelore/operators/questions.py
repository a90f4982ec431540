"""Whole questions to terms, places and answers, for a question table at once.

A term dictionary (kind, word, term) is matched against the full text of every question: words of one or more tokens,
found as whole words wherever they stand. A question then has up to five terms of each kind, places it names and areas it
names. Questions are split by route, each branch runs once over its questions, and what a stage leaves unanswered goes to
the next stage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from placelore.operators.graphq import contains_join, top_terms
from placelore.session import broadcast_if_small, durable, union_all

SEPARATORS = r"[^\pL\pN#_]+"


def normal(text):
    """Lower case, tokens of letters, digits, # and _ with one blank between them and around them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), SEPARATORS, " ")), F.lit(" "))


def found_words(questions: DataFrame, words: DataFrame, key: str, text: str, max_words: int = 200_000) -> DataFrame:
    """(key, word, pos): the words (padded with blanks) that each normalized text holds, with their first position.

    Up to ``max_words`` words (counted) are compiled to one automaton that reads each text once; more of them are met
    by an equi join on their rarest letter group.
    """
    asked = questions.select(key, normal(F.col(text)).alias("_text"))
    padded = words.select("word", normal(F.col("word")).alias("_w")).filter("trim(_w) <> ''").distinct()
    if padded.limit(max_words + 1).count() > max_words:
        met = contains_join(padded, "_w", asked, "_text", long_texts=True)
        return met.join(padded, "_w").select(key, "word", F.instr("_text", F.col("_w")).cast("bigint").alias("pos"))
    sent = questions.sparkSession.sparkContext.broadcast([(r["_w"], r["word"]) for r in padded.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, by_form = ahocorasick.Automaton(), {}
        for form, word in sent.value:
            by_form.setdefault(form, []).append(word)
        for form, same in by_form.items():
            automaton.add_word(form, (len(form), same))
        if by_form:
            automaton.make_automaton()
        for batch in batches:
            rows, words_, at = [], [], []
            for i, one in enumerate(batch.column("_text").to_pylist()):
                first = {}
                for end, (size, same) in automaton.iter(one) if by_form and one else ():
                    for word in same:
                        first.setdefault(word, end - size + 2)
                for word, pos in first.items():
                    rows.append(i), words_.append(word), at.append(pos)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int64())), pa.array(words_, pa.string()), pa.array(at, pa.int64())], names=[key, "word", "pos"])

    return asked.mapInArrow(run, f"{key} {questions.schema[key].dataType.simpleString()}, word string, pos bigint")


def match_terms(questions: DataFrame, dictionary: DataFrame, key: str = "qid", text: str = "asked", most: int = 5) -> DataFrame:
    """(key, kind, term, nth): the first ``most`` terms of each kind in order of appearance, each once, ties by name.

    ``dictionary``: (kind, word, term); a word may stand for several terms and a term may have several words.
    """
    met = found_words(questions, dictionary.select("word").distinct(), key, text).join(dictionary.distinct(), "word")
    first = met.groupBy(key, "kind", "term").agg(F.min("pos").alias("pos"))
    nth = F.row_number().over(W.partitionBy(key, "kind").orderBy("pos", "term"))
    return first.withColumn("nth", nth).filter(F.col("nth") <= most).select(key, "kind", "term", "nth")


def rewritten(terms: DataFrame, rewrites: DataFrame, key: str = "qid") -> DataFrame:
    """Terms with those replaced whose question also holds a trigger: ``rewrites`` is (kind, trigger, term, instead);
    triggers are terms of kind ``trigger``."""
    on = terms.filter("kind = 'trigger'").select(key, F.col("term").alias("trigger"))
    rule = on.join(rewrites, "trigger").groupBy(key, "kind", "term").agg(F.min("instead").alias("instead"))
    return terms.join(rule, [key, "kind", "term"], "left").select(key, "kind", F.coalesce("instead", "term").alias("term")).distinct()


class Avoided(NamedTuple):
    """What questions leave out: ``asked`` (key, trigger) and ``bad`` (trigger, place_id). Kept apart, as a trigger's places grow with the places."""

    asked: DataFrame
    bad: DataFrame


def avoided_places(terms: DataFrame, has: DataFrame, rules: DataFrame, key: str = "qid") -> Avoided:
    """Places to leave out: those with a negative edge to a term that the question's trigger rules out.

    ``rules``: (trigger, avoid, min_pct); an edge counts if its term holds ``avoid`` and its share is above ``min_pct``.
    """
    on = terms.filter("kind = 'trigger'").select(key, F.col("term").alias("trigger")).join(rules.select("trigger").distinct(), "trigger", "left_semi")
    held = contains_join(rules, "avoid", has.select(F.col("term").alias("held")).distinct(), "held").select("avoid", "held")
    bad = (has.filter("sentiment = 'negative'").join(held.join(rules, "avoid"), F.col("term") == F.col("held"))
           .filter("pct > min_pct").select("trigger", "place_id").distinct())
    return Avoided(on.select(key, "trigger").distinct(), bad)


def _listed(terms: DataFrame, kind: str, name: str, key: str) -> DataFrame:
    return terms.filter(F.col("kind") == kind).groupBy(key).agg(F.array_sort(F.collect_set(F.lower("term"))).alias(name))


def ask_any(questions: DataFrame, terms: DataFrame, has: DataFrame, kind: str, key: str = "qid", avoided: Avoided | None = None,
            sentiment=None, limit: int = 10, features: str | None = "feature") -> DataFrame:
    """Places for any of a question's terms of one kind, in the places and areas it names, at most min(suggested, limit).

    Edges are ranked once for each term, area and set of triggers, and cut to ``limit``: the first of a question are among
    the first of its terms and areas. Questions that ask the same share one signature. Where a question names places, only
    their edges are looked up. Edges that are negative or have no sentiment are left out unless ``sentiment`` says otherwise.
    """
    none = F.array().cast("array<string>")
    q = questions.select(key, "suggested").join(_listed(terms, kind, "wanted", key), key)
    for k, name in (("place", "named"), ("location", "areas")):
        q = q.join(_listed(terms, k, name, key), key, "left")
    if avoided is None:
        q = q.withColumn("rules", none)
    else:
        q = q.join(avoided.asked.groupBy(key).agg(F.array_sort(F.collect_set("trigger")).alias("rules")), key, "left").withColumn("rules", F.coalesce("rules", none))
    parts = ["wanted", "named", "areas", "rules"]
    q = q.withColumn("sid", F.xxhash64(F.to_json(F.struct(*parts))))
    sig = q.select("sid", *parts).dropDuplicates(["sid"])
    edges = has.filter((F.col("kind") == kind) & (F.col("sentiment") != "negative" if sentiment is None else sentiment))
    one = sig.select(F.explode("wanted").alias("one")).distinct()
    met = contains_join(one, "one", edges.select("term").distinct(), "term").select("one", "term")
    # what a signature asks for, cell by cell: a term in an area, '*' for anywhere
    anywhere, place = F.lit("*"), F.lower("place_name")
    area_of = lambda c: F.concat(F.lit("="), F.lower(c))
    asked = sig.withColumn("one", F.explode("wanted")).join(met, "one").withColumn(
        "area", F.explode(F.when(F.col("areas").isNull(), F.array(anywhere)).otherwise(F.transform("areas", area_of)))).select("sid", "term", "area", "named", "rules").distinct()
    open_, named = asked.filter("named is null").drop("named"), asked.filter("named is not null").withColumn("_p", F.explode("named")).drop("named")
    lies = F.array_distinct(F.array_compact(F.array(anywhere, area_of("district"), area_of("province"))))
    cells = edges.withColumn("area", F.explode(lies))
    rest = lambda hits: hits
    if avoided is not None:
        ruled = sig.select("rules").distinct().withColumn("trigger", F.explode("rules")).join(avoided.bad, "trigger").select("rules", "place_id").distinct()
        rest = lambda hits: hits.join(ruled, ["rules", "place_id"], "left_anti")
    wanted_cells = open_.select("term", "area", "rules").distinct()
    first = F.row_number().over(W.partitionBy("term", "area", "rules").orderBy(F.desc("pct"), "place_name"))
    ranked = rest(cells.join(wanted_cells, ["term", "area"])).withColumn("_c", first).filter(F.col("_c") <= limit).drop("_c")
    hits = open_.join(ranked, ["term", "area", "rules"]).unionByName(rest(named.join(cells.withColumn("_p", place), ["term", "area", "_p"]).drop("_p")))
    hits = hits.drop("area", "rules").dropDuplicates(["sid", "place_id", "term"])
    rank = F.row_number().over(W.partitionBy("sid").orderBy(F.desc("pct"), "place_name", "term"))
    top = hits.withColumn("rank", rank).filter(F.col("rank") <= limit)
    if features:
        top = top.join(top_terms(has, features), "place_id", "left")
    return q.select(key, "suggested", "sid").join(top, "sid").filter(F.col("rank") <= F.col("suggested")).drop("sid", "suggested")


def meet_all(terms: DataFrame, has: DataFrame, kinds: dict, key: str = "qid", facts: DataFrame | None = None) -> DataFrame:
    """(key, place_id, place_name): places that have an edge for every kind the question asks for, inside the areas it names.

    ``kinds``: kind to the condition its edges must meet; questions with fewer than two of the kinds are left out. Questions
    that ask the same share one signature, and a term meets its places once: places are dealt by their id, meet the signatures
    there and get ``facts`` (place_id, ...); they are put to questions last, and what comes of that is not shuffled.
    """
    want = terms.filter(F.col("kind").isin(*kinds))
    q = want.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("kind", "term"))).alias("wanted"), F.count_distinct("kind").alias("_kinds")).filter("_kinds > 1")
    q = q.join(_listed(terms, "location", "areas", key), key, "left").withColumn("sid", F.xxhash64(F.to_json(F.struct("wanted", "areas"))))
    q = durable(q)  # read for the signatures and for the answers
    sig = q.select("sid", "wanted", "areas", "_kinds").dropDuplicates(["sid"])
    one = want.select(F.col("term").alias("one")).distinct()
    good = union_all([has.filter((F.col("kind") == k) & cond) for k, cond in kinds.items()])
    met = contains_join(one, "one", good.select("term").distinct(), "term").select("one", "term")
    spots = good.join(met, "term").select("kind", "one", "place_id", "place_name", "district", "province").repartition("place_id").distinct()
    inside = F.col("areas").isNull() | F.array_contains("areas", F.lower("district")) | F.array_contains("areas", F.lower(F.coalesce("province", F.lit(""))))
    bit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(1 << i)) for i, k in enumerate(kinds)])
    asked = broadcast_if_small(sig.select("sid", "areas", "_kinds", F.inline("wanted")).withColumnRenamed("term", "one"), 200_000)
    hits = spots.join(asked, ["kind", "one"]).filter(inside)
    hits = hits.groupBy("place_id", "place_name", "sid", "_kinds").agg(F.bit_or(bit).alias("_hit")).filter(F.bit_count("_hit") == F.col("_kinds")).drop("_hit", "_kinds")
    more = []
    if facts is not None:
        hits, more = hits.join(broadcast_if_small(facts, 100_000), "place_id"), [c for c in facts.columns if c != "place_id"]
    return hits.join(broadcast_if_small(q.select(key, "sid"), 500_000), "sid").select(key, "place_id", "place_name", *more)


def first_answer(questions: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], key: str = "qid") -> DataFrame:
    """Answers of the first stage that has any, question by question, with the stage's name as ``stage``.

    A stage is asked only what the stages before it left open. All stages return the same columns, with ``key``.
    """
    out, left = [], questions
    for name, stage in stages:
        found = durable(stage(left))
        out.append(found.withColumn("stage", F.lit(name)))
        left = left.join(found.select(key).distinct(), key, "left_anti")
    return union_all(out)


def dispatch(routed: DataFrame, branches: dict[str, Callable[[DataFrame], DataFrame]], otherwise: Callable[[DataFrame], DataFrame] | None = None, key: str = "qid") -> DataFrame:
    """Facts (key, route, place_name, fact) of all questions: each branch runs once, over the questions of its route.

    ``routed`` has a column ``route``; routes without a branch and questions whose branch found nothing go to
    ``otherwise``, whose facts keep the name of the route.
    """
    cols = [key, "route", "place_name", "fact"]
    parts = [branch(routed.filter(F.col("route") == name)).withColumn("route", F.lit(name)).select(*cols) for name, branch in branches.items()]
    facts = durable(union_all(parts))
    if otherwise is None:
        return facts
    left = routed.join(facts.select(key).distinct(), key, "left_anti")
    rest = otherwise(left).join(left.select(key, "route"), key).select(*cols)
    return facts.unionByName(rest)
