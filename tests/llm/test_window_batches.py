"""Windows run through the network in batches that stay in a core's cache, sorted over blocks of several MB."""

from __future__ import annotations

import random

from panelwright.llm import pii


def test_batches_change_no_span(monkeypatch):
    draw, weights = random.Random(2), pii.train(rounds=20)
    texts = [" ".join(draw.choice(["mail a.b@c.org", "+1 555 123 4567", "word", "10.0.0.1", "4111.1111.1111.1111"]) for _ in range(draw.randrange(1, 90))) for _ in range(60)]
    assert pii.AT_ONCE <= 512 and pii.SORTED_BYTES > 1 << 20
    pii._DECODED.clear()
    whole = pii.find_spans(texts, weights)
    monkeypatch.setattr(pii, "AT_ONCE", 7)
    pii._DECODED.clear()
    assert pii.find_spans(texts, weights) == whole
