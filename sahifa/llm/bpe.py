"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 7).

The merges are compiled into an automaton over token arcs, one merge gadget after the other:
the gadget of a merge ``a b -> c`` adds the arc label ``c`` beside the path ``a b`` and closes
that path. What the gadgets leave open at a seam of two labels is a property of the pair alone.
Read byte by byte the automaton is deterministic: to each position of a word leads exactly one
open path, and a state knows the last label of the paths that a longer label may still go on
from. Its transition table is filled cell by cell as words need it (the whole table would have
a cell for each state and byte) and holds a bounded number of cells; when it is full it starts
anew. Encoding a pre-split word is one table step a byte, and the labels are read back from the
last state; nothing is searched and nothing tried twice. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import array
import base64
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sahifa.operators.rowmap import map_rows

TOKENIZERS = "/opt/tokenizers"
# The pre-splitting pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_MEMO_BYTES = 64_000_000
MOST_STEPS = 400_000  # cells of the table and of the seams behind it that a worker holds


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_RUN_OF_BLANKS = re.compile(r" \s|\s ").search


class _Chunks(dict):
    """Chunk after a space -> its packed ids; bounded."""

    def __init__(self, tool: TokenAutomaton) -> None:
        super().__init__()
        self._tool = tool
        self._size = 0

    def __missing__(self, chunk: str) -> bytes:
        found = self._tool._chunk_ids(" " + chunk)
        if self._size > _MEMO_BYTES:
            self.clear()
            self._size = 0
        self._size += len(found) + 2 * len(chunk) + 120
        self[chunk] = found
        return found


class TokenAutomaton:
    """The automaton of one vocabulary of ranks (label bytes -> id, ids in the order of the merges)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, most_steps: int = MOST_STEPS) -> None:
        import regex

        self.labels = {i: t for t, i in ranks.items()}
        self.ranks = ranks
        self.most_steps = most_steps
        self._split = regex.compile(pattern).findall
        self._left: dict[int, int] = {}
        self._right: dict[int, int] = {}
        self._gadgets: dict[tuple[int, int], int] = {}
        self._memo: dict[str, bytes] = {}
        self._held = 0
        self._chunks = _Chunks(self)
        for label, c in sorted(ranks.items(), key=lambda x: x[1]):
            if len(label) > 1:
                self._add_gadget(label, c)
        self._openings = frozenset(label[:k] for label in ranks for k in range(1, len(label)))
        self._clear()

    def _clear(self) -> None:
        """The table as it is before any word: the state at a word's start alone."""
        self._open: dict[tuple[int, int], bool] = {}
        self._numbers: dict[tuple[bytes, tuple[int, ...]], int] = {(b"", (-1,)): 0}
        self._states: list[tuple[bytes, tuple[int, ...]]] = [(b"", (-1,))]
        self._last: list[int] = [-1]
        self._steps: dict[int, int] = {}

    def _add_gadget(self, label: bytes, c: int) -> None:
        """Add label ``c``: the two arcs it joins are the path the gadgets so far leave for its bytes."""
        path = self._merge_below(label, c)
        if len(path) != 2:
            raise ValueError(f"label {c} isn't made by one merge")
        a, b = path
        self._left[c], self._right[c] = a, b
        self._gadgets[a, b] = c

    def _merge_below(self, label: bytes, limit: int) -> list[int]:
        parts = [self.ranks[label[i : i + 1]] for i in range(len(label))]
        while len(parts) > 2:
            best, at = limit, -1
            for i in range(len(parts) - 1):
                c = self._gadgets.get((parts[i], parts[i + 1]), limit)
                if c < best:
                    best, at = c, i
            if at < 0:
                break
            parts[at : at + 2] = [best]
        return parts

    def is_open(self, a: int, b: int) -> bool:
        """Whether arc ``b`` may follow arc ``a``: undo gadgets at the seam, newest first, and see whether an older one would have closed it."""
        known = self._open.get((a, b))
        if known is not None:
            return known
        left, right, gadgets = self._left, self._right, self._gadgets
        x, y = a, b
        # ids from which on a gadget at the seam comes too late, for either side
        limit = 1 << 60
        answer = True
        while True:
            c = gadgets.get((x, y))
            if c is not None and c < limit:
                answer = False
                break
            can_x, can_y = x in left, y in left
            if not can_x and not can_y:
                break
            if can_x and (not can_y or x > y):
                limit, x = x, right[x]
            else:
                limit, y = y + 1, left[y]
        self._open[a, b] = answer
        return answer

    def _step(self, state: int, byte: int) -> int:
        """Fill one cell of the table: the state after ``state`` and ``byte``.

        A state is the longest end of what was read that a label still goes on with, and the
        last label of the path to each of its positions. The label that ends at the new byte is
        the one that may follow the path to where it starts; the gadgets leave exactly one.
        """
        tail, paths = self._states[state]
        tail += bytes((byte,))
        paths += (-1,)
        n = len(tail)
        for size in range(n, 0, -1):
            label = self.ranks.get(tail[n - size :])
            if label is not None and (paths[n - size] < 0 or self.is_open(paths[n - size], label)):
                break
        paths = (*paths[:-1], label)
        while tail and tail not in self._openings:
            tail, paths = tail[1:], paths[1:]
        after = self._numbers.setdefault((tail, paths), len(self._states))
        if after == len(self._states):
            self._states.append((tail, paths))
            self._last.append(label)
        self._steps[state << 8 | byte] = after
        return after

    def encode_bytes(self, word: bytes) -> list[int]:
        """The one open path over the bytes of a pre-split word: a table step for each byte, then back along the labels the states name."""
        if len(self._steps) + len(self._open) > self.most_steps:
            self._clear()
        steps, state, passed = self._steps, 0, []
        for byte in word:
            after = steps.get(state << 8 | byte)
            state = self._step(state, byte) if after is None else after
            passed.append(state)
        path, at, last, labels = [], len(word), self._last, self.labels
        while at:
            label = last[passed[at - 1]]
            path.append(label)
            at -= len(labels[label])
        path.reverse()
        return path

    def word_ids(self, word: str) -> bytes:
        """Ids of a pre-split word as packed 32-bit integers; kept in a bounded memo."""
        found = self._memo.get(word)
        if found is None:
            found = array.array("i", self.encode_bytes(word.encode("utf-8", "surrogatepass"))).tobytes()
            if self._held > _MEMO_BYTES:
                self._memo.clear()
                self._held = 0
            self._memo[word] = found
            self._held += len(found) + 2 * len(word) + 120
        return found

    def packed(self, text: str | None) -> bytes:
        """Ids of a text, packed.

        The pre-splitting pattern never joins what lies on the two sides of a space between two
        visible characters, save that the space opens the second piece; so such spaces cut the
        text into chunks, each of which is split and encoded once and then found in the memo.
        """
        if not text:
            return b""
        if _RUN_OF_BLANKS(text):
            word_ids = self.word_ids
            return b"".join([word_ids(w) for w in self._split(text)])
        first, *rest = text.split(" ")
        return self._chunk_ids(first) + b"".join(map(self._chunks.__getitem__, rest))

    def _chunk_ids(self, chunk: str) -> bytes:
        return b"".join([self.word_ids(w) for w in self._split(chunk)])

    def encode(self, text: str | None) -> list[int]:
        return array.array("i", self.packed(text)).tolist()

    def decode(self, ids: list[int] | None) -> str:
        return b"".join([self.labels[i] for i in ids or ()]).decode("utf-8", "replace")


def shipped(df: DataFrame, path: str) -> Callable[[], TokenAutomaton]:
    """What makes the automaton in a worker; the ranks file is sent to the executors, which need not have it."""
    context = df.sparkSession.sparkContext
    sent = context.__dict__.setdefault("_sahifa_files", set())
    if path not in sent:
        context.addFile(path)
        sent.add(path)
    name = os.path.basename(path)

    def make() -> TokenAutomaton:
        from pyspark import SparkFiles

        return automaton(SparkFiles.get(name))

    return make


@lru_cache(maxsize=2)
def automaton(path: str) -> TokenAutomaton:
    """The compiled automaton of a ranks file, once per Python worker."""
    return TokenAutomaton(read_ranks(path))


def ranks_path(folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> str:
    return os.path.join(folder, f"{name}.tiktoken")


def encode_documents(df: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, ids)``: every row once; empty and null texts give an empty list; other columns are ignored."""
    path = path or ranks_path()

    def run(tool, ids, texts):
        packed = [tool.packed(t) for t in texts]
        offsets = np.zeros(len(packed) + 1, dtype=np.int32)
        np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
        data = b"".join(packed)
        values = pa.Array.from_buffers(pa.int32(), len(data) // 4, [None, pa.py_buffer(data)])
        return [ids, pa.ListArray.from_arrays(pa.array(offsets), values)]

    return map_rows(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, ids array<int>", init=shipped(df, path))


def token_counts(df: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, source, n_tokens)``: sizes only, so no ids leave the Python worker."""
    path = path or ranks_path()

    def run(tool, ids, sources, texts):
        return [ids, sources, [len(tool.packed(t)) // 4 for t in texts]]

    return map_rows(df.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text"), run, "doc_id long, source string, n_tokens long", init=shipped(df, path))


def decode_documents(df: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)``; null ids give an empty text."""
    path = path or ranks_path()
    return map_rows(df.select("doc_id", "ids"), lambda tool, keys, ids: [keys, [tool.decode(i) for i in ids]], "doc_id long, text string", init=shipped(df, path))
