"""Windows that may hold spans are decoded together over many batches; the network's scores are those of a plain recurrence."""

from __future__ import annotations

import random

import numpy as np

from panelwright.llm import pii


def _plain(x: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Scores (time, label) of one window, a unit at a time as the papers have it."""
    squash = lambda v: v / (1 + np.abs(v))
    h, scores = w["fr"].shape[0], np.zeros((len(x), pii.LABELS)) + w["bias"]
    for table, rec, head, order in ((w["ft"], w["fr"], w["out"][:h], range(len(x))), (w["bt"], w["br"], w["out"][h:], range(len(x) - 1, -1, -1))):
        state, cell = np.zeros(h), np.zeros(h)
        for t in order:
            i, f, o, g = np.split(squash(table[x[t]].astype(float) + state @ rec), 4)
            cell = (1 + f) / 2 * cell + (1 + i) / 2 * g
            state = (1 + o) / 2 * squash(cell)
            scores[t] += state @ head
    return scores


def test_scores_are_those_of_a_plain_recurrence():
    w, draw = pii.train(rounds=20), np.random.default_rng(3)
    steps = pii.LAID_OUT + pii.SCORED + 5
    length = np.array([7, pii.LAID_OUT + 1, steps - 1])
    x = np.full((3, steps), 10, np.uint8)
    for row, n in zip(x, length, strict=True):
        row[:n] = draw.integers(0, pii.SYMBOLS, n)
    emit = pii.emissions(x, w, length)
    for r, n in enumerate(length.tolist()):
        assert np.allclose(emit[:n, :, r], _plain(x[r, :n], w), atol=1e-3)
        assert (emit[n:, 1:, r] < -1e3).all()


def test_viterbi_takes_many_batches_at_once(monkeypatch):
    """Before, it ran once for each batch with a window that it couldn't skip, however few these were."""
    draw, w, calls = random.Random(4), pii.train(rounds=20), []
    texts = ["mail a.b@c.org " + " ".join(draw.choice(["word", "10.0.0.1", "+1 555 123 4567"]) for _ in range(draw.randrange(1, 90))) for _ in range(80)]
    plain, old = {}, pii._viterbi
    for text in texts:
        x = np.append(pii.symbols(text)[: pii.WINDOW], 10).astype(np.uint8)[None]
        plain[text] = pii.decode(x, w, np.array([x.shape[1] - 1]))[0, :-1]
    monkeypatch.setattr(pii, "_viterbi", lambda emit, trans: calls.append(emit.shape[2]) or old(emit, trans))
    monkeypatch.setattr(pii, "AT_ONCE", 16)
    monkeypatch.setattr(pii, "_all_outside", lambda emit, trans: np.arange(emit.shape[2]) != 3)
    pii._DECODED.clear()
    pii._labels_of(texts, w)
    assert calls == [5]
    monkeypatch.undo()
    pii._DECODED.clear()
    for text, labels in zip(texts, pii._labels_of(texts, w), strict=True):
        assert len(text) > pii.WINDOW or (labels == plain[text]).all()
