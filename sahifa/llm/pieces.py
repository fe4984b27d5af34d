"""Splitting oversized items at natural boundaries (problem 1).

Words get running offsets (a prefix sum over the words each token holds), ends of sentences
form a sorted array of offsets, and each cut is one binary search for the last end of a
sentence within the limit. The next piece starts ``overlap`` words before the cut. Where no
end of a sentence helps, the cut is made at the limit.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sahifa.llm.oneform import one_form
from sahifa.llm.words import Tokens, ranges, raw_words
from sahifa.operators.rowmap import map_batches

# What ends a sentence, and what may close it after that.
_ENDS = ".؟?!۔…"
_CLOSERS = "»)]"
# Line breaks.
_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
_BREAK_SET = frozenset(_BREAKS)


class _Shape(dict):
    """Token -> ``(words, ends)``: its visible words, and after how many of them a sentence ends; bounded."""

    def __missing__(self, token: str) -> tuple[list[str], list[int]]:
        if len(self) >= 400_000:
            self.clear()
        words: list[str] = []
        ends: list[int] = []
        lines = (token,) if _BREAK_SET.isdisjoint(token) else token.translate(_TO_LF).split("\n")
        for k, line in enumerate(lines):
            if k:
                ends.append(len(words))
            for word in raw_words(line):
                form = one_form(word)
                if form:
                    words.append(word)
                    bare = form.rstrip(_CLOSERS)
                    if bare and bare[-1] in _ENDS:
                        ends.append(len(words))
        self[token] = shape = words, ends
        return shape


_TO_LF = str.maketrans({c: "\n" for c in _BREAKS})
_SHAPES = _Shape()


def split_tokens(tokens: list[str | None] | None) -> tuple[list[str], list[int], list[int]]:
    """Words of a token array, the index of each word's token, and the sorted ends of sentences.

    An end is the number of words up to and including the last word of a sentence.
    """
    words: list[str] = []
    origin: list[int] = []
    ends: list[int] = []
    for i, token in enumerate(tokens or ()):
        own, stops = _SHAPES[token or ""]
        ends += [e for e in (len(words) + stop for stop in stops) if e and (not ends or e > ends[-1])]
        words += own
        origin += [i] * len(own)
    return words, origin, list(dict.fromkeys(ends))


def cut_points(n: int, ends: list[int], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces ``[start, stop)`` of at most ``limit`` words, each after the first repeating ``overlap``."""
    if n == 0:
        return []
    pieces = []
    start = done = 0
    while True:
        if n - start <= limit:
            pieces.append((start, n))
            return pieces
        at = bisect_right(ends, start + limit) - 1
        stop = ends[at] if at >= 0 and ends[at] > done and ends[at] > start + overlap else start + limit
        pieces.append((start, stop))
        done = stop
        start = stop - overlap


def cut_class(n: int, ends: list[int], limit: int) -> str:
    """``forced`` if the cutting, without overlap, must cut inside a sentence, else ``natural``.

    Cut at ends of sentences, each piece begins where a sentence does; then the only thing that
    leaves the binary search without an end is a sentence of more than ``limit`` words.
    """
    whole = {*ends, n}
    return "natural" if all(stop in whole for _, stop in cut_points(n, ends, limit, 0)) else "forced"


class _Batch:
    """Words and ends of sentences of the rows of an Arrow column of tokens, as running offsets.

    Each spelling of a token is looked at once; words and ends are spread by index.
    """

    def __init__(self, tokens: pa.Array) -> None:
        self.tokens = Tokens(tokens)
        self.sizes, self.word, self.origin = self._words()
        self.starts = np.cumsum(self.sizes) - self.sizes
        counts, stops, at = self.tokens.spread(lambda t: _SHAPES[t][1], np.int64)
        held = np.array([len(_SHAPES[t][0]) for t in self.tokens.spellings], dtype=np.int64)[self.tokens.codes]
        before = np.cumsum(held) - held
        self.ends = before[at] + stops  # of the whole batch; the first word of a row may repeat its start
        self.end_bounds = np.concatenate(([0], np.cumsum(counts)))

    def _words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place: list[str] = []
        first = {}
        for t in self.tokens.spellings:
            first[t] = len(place)
            place += _SHAPES[t][0]
        self.spellings = pa.array(place, type=pa.string())
        return self.tokens.spread(lambda t: range(first[t], first[t] + len(_SHAPES[t][0])), np.int64)

    def ends_of(self, row: int) -> list[int]:
        """Sorted ends of a row's sentences, as numbers of its words."""
        own = np.unique(self.ends[self.end_bounds[row] : self.end_bounds[row + 1]] - self.starts[row])
        return own[own > 0].tolist()


def split_pieces(df: DataFrame, limit: int = 120, overlap: int = 10) -> DataFrame:
    """Pieces of ``(pos_id, tokens, tags)``: one row per piece, words and tags cut together.

    A word takes the tag of its token. Tags that are missing come out as null arrays; where
    there are fewer tags than tokens the rest is null, surplus tags are dropped. Rows with no
    words (null, empty or unseen tokens) have no pieces; repeated rows are each cut; other
    columns are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than limit")

    def run(ids, tokens, tags):
        batch = _Batch(tokens)
        rows, numbers, starts, stops = [], [], [], []
        for row in np.flatnonzero(batch.sizes).tolist():
            n = int(batch.sizes[row])
            for no, (a, b) in enumerate(cut_points(n, batch.ends_of(row) if n > limit else [], limit, overlap)):
                rows.append(row)
                numbers.append(no)
                starts.append(a)
                stops.append(b)
        rows, starts, stops = (np.array(x, dtype=np.int64) for x in (rows, starts, stops))
        words = ranges(batch.starts[rows] + starts, stops - starts)
        offsets = pa.array(np.concatenate(([0], np.cumsum(stops - starts))).astype(np.int32))
        of = np.repeat(rows, stops - starts)
        nth = batch.origin[words] - batch.tokens.offsets[of]  # the word's token in its row
        counts = pc.fill_null(pc.list_value_length(tags), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, bounds = tags.flatten(), np.cumsum(counts) - counts
        there = nth < counts[of]
        cut = flat.take(pa.array(np.where(there, bounds[of] + nth, 0), mask=~there))
        none = tags.is_null().to_numpy(zero_copy_only=False)[rows]
        return [
            ids.take(pa.array(rows)), numbers, starts, stops, pa.ListArray.from_arrays(offsets, batch.spellings.take(pa.array(batch.word[words]))) if len(rows) else [],
            pa.ListArray.from_arrays(offsets, cut, mask=pa.array(none)) if len(rows) else [],
        ]

    return map_batches(df.select("pos_id", "tokens", "tags"), run, "pos_id long, piece int, word_start int, word_end int, words array<string>, tags array<string>")


def oversized(df: DataFrame, limit: int = 120) -> DataFrame:
    """``(pos_id, cut_class)`` of the rows with more than ``limit`` words: ``forced`` where the cutting must cut inside a sentence, else ``natural``."""

    def run(ids, tokens):
        batch = _Batch(tokens)
        rows = np.flatnonzero(batch.sizes > limit)
        return [ids.take(pa.array(rows)), [cut_class(int(batch.sizes[r]), batch.ends_of(r), limit) for r in rows]]

    return map_batches(df.select("pos_id", "tokens"), run, "pos_id long, cut_class string")
