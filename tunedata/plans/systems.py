"""Deterministic stand-in translation systems (no model is shipped).

Each factory returns ``predict(prompt, src, tgt)`` over numpy arrays and answers in the
chat format (prompt, then the reply), so the reply extraction runs as on real output.
"""

from __future__ import annotations

import numpy as np


def _answer(prompts, answers):
    return np.array([f"{p} {a}" for p, a in zip(prompts, answers)], dtype=object)


def make_echo():
    """Copies the source sentence."""

    def predict(prompt, src, tgt):
        return _answer(prompt, src)

    return predict


def make_half():
    """The first half of the reference's words (a short hypothesis: brevity penalty)."""

    def predict(prompt, src, tgt):
        out = []
        for t in tgt:
            w = t.split()
            out.append(" ".join(w[: len(w) // 2]))
        return _answer(prompt, out)

    return predict


def make_reversed():
    """The reference's words in reverse order (unigram matches, few longer n-grams)."""

    def predict(prompt, src, tgt):
        return _answer(prompt, [" ".join(reversed(t.split())) for t in tgt])

    return predict


SYSTEMS = {"echo": make_echo, "half": make_half, "reversed": make_reversed}
