"""Forward passes of the recurrent taggers in numpy, over parameter tables.

No trained weights come with this repository. Where there are some, as a mapping from parameter
names to arrays (the names a recurrent layer's parameters usually have: ``weight_ih_l0``,
``weight_hh_l0_reverse``, ...), these classes run them in Arrow batches by way of
``taggers.apply_tagger``; nothing but numpy is needed on the executors.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np

Parameters = Mapping[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def lstm(x: np.ndarray, p: Parameters, suffix: str, backward: bool) -> tuple[np.ndarray, np.ndarray]:
    """Outputs ``(batch, steps, hidden)`` and the last state of one direction of one layer; gates stand in the order input, forget, cell, output."""
    recurrent = p[f"weight_hh_{suffix}"].T
    size = recurrent.shape[0]
    drive = x @ p[f"weight_ih_{suffix}"].T + p[f"bias_ih_{suffix}"] + p[f"bias_hh_{suffix}"]
    state = memory = np.zeros((x.shape[0], size), dtype=drive.dtype)
    out = np.empty((*x.shape[:2], size), dtype=drive.dtype)
    steps = range(x.shape[1])
    for t in reversed(steps) if backward else steps:
        gates = drive[:, t] + state @ recurrent
        take, keep, emit = (_sigmoid(gates[:, k * size : (k + 1) * size]) for k in (0, 1, 3))
        memory = keep * memory + take * np.tanh(gates[:, 2 * size : 3 * size])
        state = emit * np.tanh(memory)
        out[:, t] = state
    return out, state


def bilstm(x: np.ndarray, p: Parameters, prefix: str, layers: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of stacked layers in both directions, and the last states of the last layer, forward beside backward."""
    own = {k.removeprefix(prefix): v for k, v in p.items() if k.startswith(prefix)}
    last = np.zeros((x.shape[0], 0))
    for layer in range(layers):
        forth, end = lstm(x, own, f"l{layer}", False)
        back, begin = lstm(x, own, f"l{layer}_reverse", True)
        x, last = np.concatenate([forth, back], axis=-1), np.concatenate([end, begin], axis=-1)
    return x, last


def padded(rows: Sequence[Sequence[int]], value: int = 0) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows), default=0)), value, dtype=np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


class WordTagger:
    """Words to tags: characters of a word through one layer in both directions, its last states through two layers over the words.

    ``chars`` maps characters to ids (0 pads, 1 stands for unknown ones), ``tags`` are the tags
    by id. Words are read up to ``max_chars`` characters; no words give no tags.
    """

    def __init__(self, parameters: Parameters, chars: Mapping[str, int], tags: Sequence[str], max_chars: int = 18) -> None:
        self.p, self.chars, self.tags, self.max_chars = parameters, chars, tags, max_chars

    def scores(self, words: Sequence[str]) -> np.ndarray:
        ids = padded([[self.chars.get(c, 1) for c in w[: self.max_chars]] or [1] for w in words])
        _, vectors = bilstm(self.p["char_emb.weight"][ids], self.p, "char_lstm.")
        out, _ = bilstm(vectors[None], self.p, "word_lstm.", 2)
        return out[0] @ self.p["head.weight"].T + self.p["head.bias"]

    def __call__(self, words: Sequence[str]) -> list[str]:
        return [self.tags[i] for i in self.scores(words).argmax(axis=-1)] if len(words) else []


class MarkTagger:
    """Characters of a bare text to mark classes; with tag embeddings (``tag_emb.weight``) each character is read with the tag of its word."""

    def __init__(self, parameters: Parameters, chars: Mapping[str, int], tags: Mapping[str, int] | None = None) -> None:
        self.p, self.chars, self.tags = parameters, chars, tags

    def scores(self, bare: str, word_tags: Sequence[str] | None = None) -> np.ndarray:
        x = self.p["emb.weight"][[self.chars.get(c, 1) for c in bare]]
        if self.tags is not None:
            at, ids = 0, []
            for c in bare:
                tag = word_tags[at] if word_tags is not None and at < len(word_tags) else "x"
                ids.append(self.tags.get(tag, 1))
                at += c == " "  # a plain space and nothing else goes on to the next word
            x = np.concatenate([x, self.p["tag_emb.weight"][ids]], axis=-1)
        out, _ = bilstm(x[None], self.p, "lstm.", 2)
        return out[0] @ self.p["head.weight"].T + self.p["head.bias"]

    def __call__(self, bare: str, word_tags: Sequence[str] | None = None) -> list[int]:
        return self.scores(bare, word_tags).argmax(axis=-1).tolist() if bare else []


def parameter_count(parameters: Parameters) -> int:
    return sum(int(v.size) for v in parameters.values())
