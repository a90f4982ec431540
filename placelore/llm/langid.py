"""Language ID as inference of a mixture: expectation-maximisation over n-gram likelihoods of words.

Each learned language is a distribution of the three characters around a letter. A document is a mixture of languages
by words; expectation-maximisation estimates the proportions, and the set of languages is the one with the best
penalised likelihood: a language is only added if it raises the log-likelihood by more than ``penalty * log(words)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelore.llm.common import JUDGED_BYTES, first_of_each, held_out, keep_rows, slices
from placelore.llm.letters import Letters, trigrams

BITS = 15
UNKNOWN = "und"


def learn(docs: DataFrame, max_rows: int = 1500, max_languages: int = 256) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities of hashed trigrams (one row per language), smoothed.

    Learned from whole texts with a language, held-out ids never; at most ``max_rows`` documents of each language, first
    by a hash of the id. Counting is done by Spark; one row per language and trigram reaches the driver.
    """
    known = docs.select(F.col("doc_id").cast("long"), "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    if known.select("lang").distinct().limit(max_languages + 1).count() > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    ids = first_of_each(known, "lang", "doc_id", max_rows).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text", JUDGED_BYTES):
            letters = Letters(batch.column("text").to_pylist())
            grams = trigrams(letters, BITS)
            doc = np.repeat(letters.doc, letters.ends - letters.begins)
            langs = batch.column("lang").to_pylist()
            for lang in set(langs):
                mine = np.array([x == lang for x in langs])[doc]
                sums[lang] = sums.get(lang, 0) + np.bincount(grams[mine], minlength=1 << BITS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], names=["lang", "gram", "n"])

    texts = docs.select(F.col("doc_id").cast("long"), "text", "lang").filter("text is not null and lang is not null").join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")
    counts = texts.select("lang", "text").mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts.column("lang").to_pylist()))
    table = np.full((len(names), 1 << BITS), 0.5)
    if names:
        row = np.searchsorted(np.array(names), np.array(counts.column("lang").to_pylist()))
        np.add.at(table, (row, counts.column("gram").to_numpy()), counts.column("n").to_numpy())
        table = np.log(table / table.sum(axis=1, keepdims=True))
    return names, table.astype(np.float32)


def word_likelihoods(table: np.ndarray, letters: Letters) -> np.ndarray:
    """Log-likelihood of each word (row) under each language."""
    grams = trigrams(letters, BITS)
    starts = np.concatenate([[0], np.cumsum(letters.ends - letters.begins)[:-1]])
    return np.stack([np.add.reduceat(row[grams].astype(np.float64), starts) for row in table], axis=1)


def mixture(like: np.ndarray, first: np.ndarray, allowed: np.ndarray, rounds: int = 25, close: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood per document by expectation-maximisation.

    ``like``: likelihoods of words, each row scaled to a maximum of 1; ``first``: first word of each document (all have
    words); ``allowed``: which languages each document may use. Documents that have settled leave the loop.
    """
    n = np.diff(np.append(first, len(like)))
    share = allowed / allowed.sum(axis=1, keepdims=True)
    going, rows, starts = np.arange(len(first)), like, first
    for _ in range(rounds):
        if not len(going):
            break
        size = n[going]
        joint = rows * np.repeat(share[going], size, axis=0)
        joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
        new = np.add.reduceat(joint, starts, axis=0) / size[:, None]
        moving = np.abs(new - share[going]).max(axis=1) > close
        share[going] = new
        if not moving.all():
            rows = rows[np.repeat(moving, size)]
            going = going[moving]
            starts = np.concatenate([[0], np.cumsum(n[going])[:-1]]).astype(np.int64)
    total = np.log(np.maximum((like * np.repeat(share, n, axis=0)).sum(axis=1), 1e-300))
    return share, np.add.reduceat(total, first)


def infer(table: np.ndarray, texts: list[str | None], penalty: float, most: int | None, least_share: float) -> tuple[np.ndarray, np.ndarray]:
    """Best proportions per text (zero rows for texts without letters) and the number of languages in the chosen set.

    ``most`` bounds that number (None: any number that pays for itself).
    """
    letters = Letters(texts)
    langs = len(table)
    out, chosen = np.zeros((len(texts), langs)), np.zeros(len(texts), np.int64)
    if not langs or not len(letters.doc):
        return out, chosen
    logs = word_likelihoods(table, letters)
    like = np.exp(logs - logs.max(axis=1, keepdims=True))
    first = np.flatnonzero(np.concatenate([[True], letters.doc[1:] != letters.doc[:-1]]))
    who, n = letters.doc[first], np.diff(np.append(first, len(like)))
    full, _ = mixture(like, first, np.ones((len(first), langs)))
    order = np.argsort(-full, axis=1, kind="stable")
    single = np.add.reduceat(np.log(np.maximum(like, 1e-300)), first, axis=0)
    best = np.argmax(single, axis=1)
    share = np.eye(langs)[best]
    value = single[np.arange(len(first)), best]
    size = np.ones(len(first), np.int64)
    for k in range(2, (langs if most is None else min(most, langs)) + 1):
        # a language with next to no words cannot pay for itself
        try_ = np.flatnonzero(full[np.arange(len(first)), order[:, k - 1]] * np.maximum(n, 1 / least_share) >= np.maximum(1, least_share * n))
        if not len(try_):
            break
        allowed = np.zeros((len(try_), langs))
        np.put_along_axis(allowed, order[try_, :k], 1, axis=1)
        starts = np.concatenate([[0], np.cumsum(n[try_])[:-1]]).astype(np.int64)
        member = np.zeros(len(first), bool)
        member[try_] = True
        got, total = mixture(like[np.repeat(member, n)], starts, allowed)
        total = total - penalty * (k - 1) * np.log(n[try_] + 1)
        better = total > value[try_]
        at = try_[better]
        share[at], value[at], size[at] = got[better], total[better], k
    out[who], chosen[who] = share, size
    return out, chosen


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None, penalty: float = 3.0, most: int | None = None, least_share: float = 0.02) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; lang where it is to learn): doc_id, held_out, lang_pred, score (the share of
    lang_pred), languages (map of language to share in the chosen set).

    A null or empty text and one without letters is ``und`` with score 0 and no languages, as is every text if nothing
    could be learned. The first language by name wins ties. Repeated rows get equal results; a null id counts as held
    out.
    """
    names, table = model or learn(docs)
    shared = docs.sparkSession.sparkContext.broadcast((names, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        for batch in slices(batches, "text"):
            share, size = infer(table, batch.column("text").to_pylist(), penalty, most, least_share)
            top = share.argmax(axis=1) if len(names) else np.zeros(batch.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([names[t] if s else UNKNOWN for t, s in zip(top.tolist(), size.tolist())], pa.string()),
                pa.array(share.max(axis=1).clip(0, 1) if len(names) else np.zeros(batch.num_rows)),
                pa.array([[(names[j], float(row[j])) for j in np.flatnonzero(row > 0)] for row in share], pa.map_(pa.string(), pa.float64()))],
                names=["doc_id", "lang_pred", "score", "languages"])

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, languages map<string,double>")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages")


def has_letters(texts: list[str | None]) -> np.ndarray:
    out = np.zeros(len(texts), bool)
    out[Letters(texts).doc] = True
    return out


def known_share(table: np.ndarray, texts: list[str | None], wanted: np.ndarray | None = None, margin: float = 0.3) -> np.ndarray:
    """Share of each text's words that the mixture gives to the wanted languages (rows of ``table``; None: all).

    Beside the languages stands a background under which all trigrams are equally likely, less ``margin`` in the
    log-likelihood of each; it takes the words that no language explains, but not those that a language learned from a
    few texts has merely not seen. Texts without letters have a share of 0.
    """
    letters, out = Letters(texts), np.zeros(len(texts))
    if not len(letters.doc):
        return out
    even = -(np.log(float(1 << BITS)) + margin) * (letters.ends - letters.begins)
    logs = np.concatenate([word_likelihoods(table, letters), even[:, None]], axis=1)
    like = np.exp(logs - logs.max(axis=1, keepdims=True))
    first = np.flatnonzero(np.concatenate([[True], letters.doc[1:] != letters.doc[:-1]]))
    share, _ = mixture(like, first, np.ones((len(first), len(table) + 1)))
    out[letters.doc[first]] = share[:, :-1].sum(axis=1) if wanted is None else share[:, :-1][:, wanted].sum(axis=1)
    return out


def drop_unknown(docs: DataFrame, languages: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all columns, of whose words the mixture gives at least ``least`` to the wanted
    ``languages`` (None: all learned ones). Null and empty texts and those without letters go.

    If nothing could be learned, nothing can be told apart; then every text that has letters stays.
    """
    names, table = learn(docs)
    if not names:
        return keep_rows(docs, has_letters)
    wanted = None if languages is None else np.isin(names, languages)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    return keep_rows(docs, lambda texts: known_share(shared.value, texts, wanted) >= least)
