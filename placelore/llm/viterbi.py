"""Token counts of a unigram tokenizer without its tokens: Aho-Corasick matches and a Viterbi pass that carries counts.

The automaton lists, for every end in a text, the vocabulary's pieces that end there, longest first; the pass keeps for
each end the best score and the number of pieces on the way. Ties go to the longest last piece, as in the tokenizer,
which tries starts in ascending order and only replaces a strictly worse path. An unknown character costs the lowest
score less ten and counts as its UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelore.llm.common import slices

SPACE, PENALTY = "▁", 10.0


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in the order of their ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Counter:
    """Counts the pieces of whole texts. Words repeat, so their counts are kept; ``keep`` bounds how many."""

    def __init__(self, pieces: list[tuple[str, float]], keep: int = 300_000):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - PENALTY
        self.cuts_lines = not any("\n" in p for p, _ in pieces)
        self.keep, self.known = keep, {}

    def best(self, text: str) -> tuple[int, float]:
        """Number of pieces and score of the best path through one word (no cut within)."""
        n = len(text)
        score, count, at, single = [0.0] * (n + 1), [0] * (n + 1), 0, False
        best, pieces, unknown = None, 0, self.unknown

        def close(end: int) -> None:
            nonlocal best, pieces, single
            if not single:
                other = score[end - 1] + unknown
                if best is None or other > best:
                    best, pieces = other, count[end - 1] + len(text[end - 1].encode())
            score[end], count[end] = best, pieces
            best, single = None, False

        for last, (size, own) in self.automaton.iter(text):
            while at < last:  # all matches that end before have been seen
                at += 1
                close(at)
            start = last + 1 - size
            value = score[start] + own
            if best is None or value > best:
                best, pieces = value, count[start] + 1
            single = single or size == 1
        while at < n:
            at += 1
            close(at)
        return count[n], score[n]

    def words(self, text: str) -> list[str]:
        """The parts that no piece crosses: each begins with the mark that stands for a blank, the first one gets it."""
        if not text:
            return []
        parts = text.replace(" ", SPACE).split(SPACE)
        return [SPACE + p for p in (parts if parts[0] else parts[1:])]

    def count(self, text: str | None) -> tuple[int, float]:
        known, pieces, score = self.known, 0, 0.0
        for word in self.words(text or ""):
            got = known.get(word)
            if got is None:
                if self.cuts_lines and "\n" in word:  # a line end is in no piece: a single byte between two paths
                    lines = [self.best(x) for x in word.split("\n")]
                    got = (sum(c for c, _ in lines) + len(lines) - 1, sum(s for _, s in lines) + (len(lines) - 1) * self.unknown)
                else:
                    got = self.best(word)
                if len(known) >= self.keep:
                    known.clear()
                if len(word) < 64:
                    known[word] = got
            pieces += got[0]
            score += got[1]
        return pieces, score


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_chars, n_tokens and the score of the best path.

    Null and empty texts have no tokens. Repeated rows give repeated results.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            found = [c.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([n for n, _ in found], pa.int64()),
                                              pa.array([s for _, s in found], pa.float64())], names=["doc_id", "n_chars", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_chars long, n_tokens long, score double")
