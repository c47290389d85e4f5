"""Token counts by count-only Viterbi over a unigram vocabulary (operator 10).

The pieces and scores come from a public piece vocabulary.  The text is prepared
as the tokenizer does (a leading space, spaces written as the space mark).  An
Aho-Corasick automaton lists the pieces that end at each position; the best
score and the number of pieces are carried forward, no path is kept.

Tie rule of the tokenizer: of equally good ways to reach a position the one
whose last piece is longest stays, as later starts must be strictly better.  A
character without a piece of its own costs the lowest score less 10 and counts
as many pieces as it has bytes (byte fallback).

No piece holds the space mark behind another character, and none holds a line
feed, so the best path always breaks before a space mark and around a line feed;
words are solved one by one and kept in a bounded cache.  If a vocabulary has
such pieces, whole texts are solved instead.

Defined results: null and empty texts have 0 pieces; rows are counted one by one.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from flowtrace.llm.common import id_and_text, map_batches, small_batches

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_SIZE, CACHE_CHARS = 1 << 19, 64


class Unigram:
    """A unigram vocabulary: pieces with scores."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        inner = any(SPACE in p.lstrip(SPACE) for p in scores)
        feeds = any("\n" in p for p in scores)
        self.chunks = None if inner or feeds else regex.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.cache: dict[str, int] = {}

    def pieces(self, text: str) -> int:
        """Pieces on the best path through a prepared text."""
        n, unknown, scores = len(text), self.unknown, self.scores
        best, count = [None] * (n + 1), [0] * (n + 1)
        best[0], at = 0.0, 0

        def fill(upto: int) -> None:
            # a single character without a piece: reached last, so it must be strictly better
            for i in range(at, upto):
                c = text[i]
                if c not in scores and (best[i + 1] is None or best[i] + unknown > best[i + 1]):
                    best[i + 1], count[i + 1] = best[i] + unknown, count[i] + len(c.encode())

        for end, (length, score) in self.automaton.iter(text):
            if end > at:
                fill(end)
                at = end
            start = end + 1 - length
            reached = best[start] + score
            if best[end + 1] is None or reached > best[end + 1]:
                best[end + 1], count[end + 1] = reached, count[start] + 1
        fill(n)
        return count[n]

    def _chunk(self, chunk: str) -> int:
        n = self.pieces(chunk)
        if len(chunk) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_SIZE:
                self.cache.clear()
            self.cache[chunk] = n
        return n

    def count(self, text: str) -> int:
        """Pieces of a raw text."""
        if not text:
            return 0
        ready = SPACE + text.replace(" ", SPACE)
        if self.chunks is None:
            return self.pieces(ready)
        get, chunk = self.cache.get, self._chunk
        return sum([get(c) or chunk(c) for c in self.chunks.findall(ready)])


_LOADED: dict[str, Unigram] = {}


def load(path: str) -> Unigram:
    """The vocabulary of a sentencepiece file, read once in each worker.

    Control, unknown and byte pieces are never matched in a text.
    """
    if path not in _LOADED:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = (i for i in range(sp.get_piece_size())
                 if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
        _LOADED[path] = Unigram({sp.id_to_piece(i): sp.get_score(i) for i in plain})
    return _LOADED[path]


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``n_chars`` of every row's whole text, one row per row."""
    small_batches(df.sparkSession)

    def counts(batch: pa.RecordBatch) -> dict[str, object]:
        model, texts = load(path), batch.column("text").to_pylist()
        return {"n_tokens": pa.array([model.count(t) for t in texts], pa.int64()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    return map_batches(id_and_text(df, id_col, text_col), counts, "n_tokens bigint, n_chars bigint").drop("text")
