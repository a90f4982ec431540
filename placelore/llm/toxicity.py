"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of itself and its character n-grams, hashed; a passage of some words is the average of its words'
vectors; a softmax over two classes reads the average. A misspelling shares most n-grams with what it stands for. A
document is scored by its most toxic passage, so that a long text does not hide one. Only whole documents are labelled,
so training starts with each passage under its document's label and then keeps, of a toxic document, the passages that
the model itself finds toxic (at least the highest one). A logistic curve fitted on documents left out of training turns
the highest passage into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelore.llm.common import JUDGED_BYTES, first_of_each, held_out, keep_rows, slices
from placelore.llm.letters import Letters, subwords

LOW, HIGH, BITS, FEWEST = 3, 5, 18, 8


@dataclass
class Model:
    """What scoring needs: one number per hashed subword (its vector times the softmax), the bias, the curve."""

    weight: np.ndarray
    bias: float
    slope: float
    shift: float
    words: int


def passages(letters: Letters, words: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each passage of up to ``words`` words, and its document."""
    new = np.concatenate([[True], letters.doc[1:] != letters.doc[:-1]]) if len(letters.doc) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    nth = np.arange(len(new)) - np.repeat(start, np.diff(np.append(start, len(new))))
    first = np.flatnonzero(nth % words == 0)
    return first, letters.doc[first]


def bags(letters: Letters, hashes: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passages as bags: first word and document of each, which words count (a word repeated in its passage counts
    once), and the share of a word's subwords. A passage is padded to ``words`` words and a word to FEWEST subwords, so
    that neither one repeated word nor a single letter makes a whole average."""
    first, doc = passages(letters, words)
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(letters.doc))))
    key = of.astype(np.int64) << BITS | hashes[at[:-1]] if len(of) else np.zeros(0, np.int64)
    counts = np.zeros(len(of), bool)
    counts[np.unique(key, return_index=True)[1]] = True
    return first, doc, counts, (1 / (np.maximum(np.diff(at), FEWEST) * words)).astype(np.float32)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def features(texts: list[str | None], labels: np.ndarray, words: int, most: int, rng) -> tuple[np.ndarray, ...]:
    """Subword hashes of passages end to end, their shares, the number in each passage, and each passage's document.

    All passages of toxic documents up to ``most`` in all, and as many of the others; a larger number is thinned evenly.
    """
    plan = np.array([((t or "").count(" ") + 1) / words for t in texts])
    keep = np.where(labels == 1, min(1.0, most / max(1.0, plan[labels == 1].sum())), min(1.0, most / max(1.0, plan[labels == 0].sum())))
    hashes, shares, sizes, owners = [], [], [], []
    cut = np.flatnonzero(np.diff(np.cumsum([len(t or "") for t in texts]) // JUDGED_BYTES)) + 1  # as much at a time as in scoring
    for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(texts)]):
        letters = Letters(texts[lo:hi])
        if not len(letters.doc):
            continue
        h, at = subwords(letters, LOW, HIGH, BITS)
        first, doc, counts, share = bags(letters, h, at, words)
        chosen = rng.random(len(first)) < keep[lo + doc]
        many = np.diff(at)
        word = counts & np.repeat(chosen, np.diff(np.append(first, len(letters.doc))))
        hashes.append(h[np.repeat(word, many)].astype(np.int32))
        shares.append(np.repeat(share[word], many[word]))
        sizes.append(np.add.reduceat(np.where(word, many, 0), first)[chosen])
        owners.append(lo + doc[chosen])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(hashes), join(shares), join(sizes), join(owners)


def train(texts: list[str | None], labels: np.ndarray, words: int = 6, dim: int = 8, rounds: int = 10, steps: int = 4000, batch: int = 256, rate: float = 12.0,
          least: int = 20, most: int = 120_000, clean_cost: float = 6.0, seed: int = 7) -> Model:
    """Fit on labelled texts; ``clean_cost`` says how many missed toxic documents weigh as much as one clean document
    found toxic, when the curve is placed. One class alone gives a model that scores all texts by its share."""
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, 4.0 if len(labels) and labels[0] else -4.0, words)
    rng = np.random.default_rng(seed)
    hashes, share, size, doc = features(texts, labels, words, most, rng)
    at = np.concatenate([[0], np.cumsum(size)])
    low, high = at[:-1], at[1:]
    least = min(least, 3 + int(labels.sum()) // 50)
    rounds = max(rounds, steps * batch // max(1, len(doc)))
    share *= np.bincount(hashes, minlength=1 << BITS)[hashes] >= least  # a subword met seldom says nothing, as one never met
    fit = rng.random(len(texts)) < 0.8
    vectors = np.zeros((1 << BITS, dim), np.float32)
    soft, bias = rng.uniform(-1, 1, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    goal, used = labels[doc].astype(np.int64), fit[doc]

    def raw() -> np.ndarray:
        return np.add.reduceat((vectors @ (soft[:, 1] - soft[:, 0]))[hashes] * share, low) + (bias[1] - bias[0])

    def highest(score: np.ndarray) -> np.ndarray:
        top = np.full(len(texts), -40.0)
        np.maximum.at(top, doc, score)
        return top

    for turn in range(rounds):
        chosen = np.flatnonzero(used)
        if turn >= max(2, rounds // 4):
            score = raw()
            top = highest(score)
            chosen = chosen[(goal[chosen] == 0) | (score[chosen] > 0) | (score[chosen] >= top[doc[chosen]])]
        positive = goal[chosen] == 1
        balance = np.where(positive, 0.5 / max(positive.mean(), 1e-9), 0.5 / max(1 - positive.mean(), 1e-9)).astype(np.float32)
        order = rng.permutation(len(chosen))
        step = rate * (1 - turn / rounds)
        for lo in range(0, len(order), batch):
            some = order[lo:lo + batch]
            seg = chosen[some]
            count = high[seg] - low[seg]
            edges = np.concatenate([[0], np.cumsum(count)[:-1]])
            pick = np.repeat(low[seg] - edges, count) + np.arange(count.sum())
            h, s = hashes[pick], share[pick]
            mean = np.add.reduceat(vectors[h] * s[:, None], edges)
            logit = mean @ soft + bias
            logit -= logit.max(axis=1, keepdims=True)
            p = np.exp(logit)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(seg)), goal[seg]] -= 1
            p *= balance[some][:, None]
            # of two classes the errors are opposite, so every gradient is a number times one direction
            pull = np.bincount(h, s * np.repeat(p[:, 1], count), minlength=1 << BITS).astype(np.float32)
            moved = np.flatnonzero(pull)
            vectors[moved] -= step * pull[moved, None] * (soft[:, 1] - soft[:, 0])
            soft -= 0.05 * step / batch * (mean.T @ p)
            bias -= 0.05 * step / batch * p.sum(axis=0)
    top = highest(raw())
    left = ~fit if len(set(labels[~fit].tolist())) == 2 else np.ones(len(texts), bool)
    x, y = np.clip(top[left], -30, 30), labels[left].astype(np.float64)
    each = np.where(y == 1, 0.5 / y.mean(), clean_cost * 0.5 / (1 - y.mean()))
    cuts = np.unique(x)
    wrong = [(each * ((x >= c) != y)).sum() for c in cuts]
    best = int(np.argmin(wrong))
    middle = float(cuts[best] + cuts[max(0, best - 1)]) / 2  # halfway between the lowest text called toxic and the next below
    slope = 2.0
    return Model((vectors @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]), slope, -slope * middle, words)


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    """Probability of label 1 for whole texts; without letters, what the curve gives where no passage is toxic."""
    letters = Letters(texts)
    hashes, at = subwords(letters, LOW, HIGH, BITS)
    top = np.full(len(texts), min(-10.0, model.bias))
    if len(letters.doc):
        first, doc, counts, share = bags(letters, hashes, at, model.words)
        word = np.add.reduceat(model.weight[hashes].astype(np.float64), at[:-1]) * share * counts
        np.maximum.at(top, doc, np.add.reduceat(word, first) + model.bias)
    return sigmoid(model.slope * np.clip(top, -30, 30) + model.shift)


def sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> tuple[list[str | None], np.ndarray]:
    """Up to ``max_rows`` labelled documents of each label, first by a hash of the id; held-out ids never."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter(F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    here = known.join(docs.select(F.col("doc_id").cast("long")).filter("text is not null"), "doc_id", "left_semi")
    ids = first_of_each(here, "toxic", "doc_id", max_rows)
    got = docs.select(F.col("doc_id").cast("long"), "text").filter("text is not null").join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "text").toArrow()
    order = got.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return order.column("text").to_pylist(), order.column("toxic").to_numpy()


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text; null texts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", JUDGED_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(shared.value, batch.column("text").to_pylist()))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = 3000) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.5 on) of every row of ``docs`` (doc_id, text).

    The model is trained on the driver from at most ``max_rows`` labelled documents of each label. Repeated rows get
    equal scores; rows with a null id count as held out.
    """
    model = train(*sample(docs, labels, max_rows))
    return score_documents(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = 3000) -> DataFrame:
    """The rows of ``docs``, with all columns, that ``classify`` would not call toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(train(*sample(docs, labels, max_rows)))
    return keep_rows(docs, lambda texts: scores(shared.value, texts) < 0.5)
