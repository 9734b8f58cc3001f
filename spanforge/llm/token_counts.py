"""Token counts under a unigram vocabulary: a Viterbi search that only counts.

An Aho-Corasick automaton enumerates all vocabulary matches of a word by where
they end, longest first; dynamic programming carries the best score and its number
of pieces, no back pointers.  Ties follow the unigram tokenizer exactly: at each
place matches are tried from the earliest start, a later one must be strictly
better; a character that no piece spells is an unknown piece, 10 below the lowest
score, and runs of unknown characters are one piece.

White space (Unicode) parts words, each spelled with a leading ``▁``; words cannot
share a piece, so a word's count is worked out once and remembered.

Defined results: a null or empty text has no words and no tokens; a null doc_id is
kept; repeated rows get equal results; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

_CONTROL = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
MARK = "▁"
UNKNOWN_PENALTY = 10.0


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file; special and byte pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(len(model)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class Counter:
    """Counts pieces of words; remembers up to ``limit`` words."""

    limit = 300_000

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.known: dict[str, tuple[int, int]] = {}

    def word(self, text: str) -> tuple[int, int]:
        """(pieces, unknown pieces) of a marked word."""
        n = len(text)
        score: list[float | None] = [0.0] + [None] * n
        count, lost, tail = [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        at = 0

        def pass_by(stop: int) -> None:
            """Close the places up to ``stop``: no match ends there any more."""
            nonlocal at
            while at < stop:
                at += 1
                if not single[at]:
                    value = score[at - 1] + self.unknown
                    if score[at] is None or value > score[at]:
                        new = not tail[at - 1]
                        score[at], count[at], lost[at], tail[at] = value, count[at - 1] + new, lost[at - 1] + new, True

        single = [False] * (n + 1)
        for end, (size, value) in self.automaton.iter(text):
            stop = end + 1
            pass_by(stop - 1)
            start = stop - size
            value += score[start]
            if size == 1:
                single[stop] = True
            if score[stop] is None or value > score[stop]:
                score[stop], count[stop], lost[stop], tail[stop] = value, count[start] + 1, lost[start], False
        pass_by(n)
        return count[n], lost[n]

    def text(self, text: str) -> tuple[int, int, int]:
        """(words, pieces, unknown pieces) of a text."""
        words = text.split() if not _CONTROL.search(text) else [w for w in _SPACE.split(text) if w]
        known, total, lost = self.known, 0, 0
        for w in words:
            found = known.get(w)
            if found is None:
                if len(known) >= self.limit:
                    known.clear()
                found = known[w] = self.word(MARK + w)
            total += found[0]
            lost += found[1]
        return len(words), total, lost


_counters: dict[str, Counter] = {}


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = Counter(vocabulary(path))
        counter = _counters[path]
        for batch in batches:
            found = [counter.text(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("did"), *(common.longs([x[i] for x in found]) for i in range(3))], names=["did", "n_words", "n_tokens", "n_unknown"])

    return run


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) per row; ``path`` is the vocabulary."""
    counted = common.identified(docs).mapInArrow(_counted(path), "did long, n_words long, n_tokens long, n_unknown long")
    return counted.select(common.doc_id_back().alias("doc_id"), "n_words", "n_tokens", "n_unknown")
