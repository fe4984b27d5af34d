"""Words as the problems define them, on the Python side of Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sahifa.functions import charclasses as C
from sahifa.llm.oneform import BLANKS, one_form

_MARKS = re.compile(C.DIAC_NORM)
_FOLD = str.maketrans(C.FOLD_FROM, C.FOLD_TO)
# Surrounding punctuation of a word.
PUNCTUATION = ".،,؛;:؟?!()[]{}«»\"'-…۔﴿﴾"
_MEMO = 400_000


def normalize_text(text: str) -> str:
    """Normalization of the project applied to the one form."""
    return " ".join(_MARKS.sub("", one_form(text)).translate(_FOLD).split())


class _TermMemo(dict):
    """Raw word -> its normalized form without surrounding punctuation, or "" when nothing of ``keeps`` remains."""

    def __init__(self, keeps) -> None:
        super().__init__()
        self._keeps = keeps

    def __missing__(self, word: str) -> str:
        if len(self) >= _MEMO:
            self.clear()
        bare = _MARKS.sub("", one_form(word)).translate(_FOLD).strip().strip(PUNCTUATION)
        if not any(map(self._keeps, bare)):
            bare = ""
        self[word] = bare
        return bare


_ALNUM = _TermMemo(str.isalnum)
_ALPHA = _TermMemo(str.isalpha)
_SPLIT = re.compile("[" + re.escape(BLANKS) + "]+")


def raw_words(text: str) -> list[str]:
    return text.split() if "\u2800" not in text else [w for w in _SPLIT.split(text) if w]


def plain_words(text: str | None) -> list[str]:
    """Words of the normalized text without surrounding punctuation, where a letter or digit remains."""
    if not text:
        return []
    memo = _ALNUM
    return [w for w in [memo[x] for x in raw_words(text)] if w]


def term(word: str) -> str:
    """A word as a term: normalized, without surrounding punctuation, "" unless a letter remains."""
    return _ALPHA[word]


def terms(text: str) -> list[str]:
    memo = _ALPHA
    return [w for w in [memo[x] for x in raw_words(text)] if w]


def stored_key(text: str) -> bytes:
    """128-bit key of the stored text."""
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _holds_lists(column: pa.Array) -> bool:
    return pa.types.is_list(column.type) or pa.types.is_large_list(column.type)


class Tokens:
    """The tokens of one Arrow batch, each spelling once.

    ``column`` holds texts (cut at white space here) or arrays of tokens; null rows and null
    tokens have none. ``codes`` are the tokens row after row as numbers of ``spellings``,
    ``offsets`` the bounds of the rows. A batch repeats its tokens many times, so what is asked
    of a token is asked once per spelling and spread by index.
    """

    def __init__(self, column: pa.Array) -> None:
        lists = column if _holds_lists(column) else pc.utf8_split_whitespace(column)
        self.counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        if flat.null_count:
            flat = pc.fill_null(flat, "")
        coded = flat.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.spellings = coded.dictionary.to_pylist()
        self.offsets = np.concatenate(([0], np.cumsum(self.counts)))

    def rows(self) -> np.ndarray:
        """The row of each token."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def spread(self, of: Callable[[str], Sequence[int]], dtype=np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(sizes, values, tokens)``: what ``of`` gives for each token, row after row; how many a row has; the token each value is of."""
        made = [of(t) for t in self.spellings]
        lengths = np.fromiter(map(len, made), dtype=np.int64, count=len(made))
        values = np.fromiter((v for m in made for v in m), dtype=dtype, count=int(lengths.sum()))
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        each = lengths[self.codes]
        total = np.concatenate(([0], np.cumsum(each)))
        sizes = total[self.offsets[1:]] - total[self.offsets[:-1]]
        if len(each) == total[-1] and (not len(each) or each.min() == 1):  # one for each token
            return sizes, values[starts[self.codes]], np.arange(len(each))
        tokens = np.repeat(np.arange(len(each)), each)
        return sizes, values[starts[self.codes][tokens] + np.arange(total[-1]) - total[tokens]], tokens


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers ``start, start + 1, ...`` of each range, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def stored_texts(column: pa.Array) -> list[str]:
    """Stored texts of a column of texts, or of arrays of tokens joined by one space; null as empty."""
    if not _holds_lists(column):
        return pc.fill_null(column, "").to_pylist()
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pc.fill_null(column.flatten(), ""))
    return pc.binary_join(lists, " ").to_pylist()
