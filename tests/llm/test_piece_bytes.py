"""Decoding by the bytes of pieces gives what the tokenizer decodes."""

from __future__ import annotations

import random

from panelwright.llm import sentencepieces as sp
from panelwright.llm.tokens import default_path


def test_decoded_like_the_tokenizer():
    """Texts, and random ids with byte pieces that are no UTF-8 on their own, at row ends, and the unknown piece."""
    own, draw = sp.backend(default_path("piece_bpe_32k.model")), random.Random(4)
    texts = ["", " ", "  two  spaces ", "a\nb\tc", "ñandú — 日本語 \U0001f600\U00013000", "<0x41> <unk> ▁ mark", "é" * 50]
    by_text = own.verified(texts)[0]
    n = len(own.model["pieces"])
    odd = [draw.choices(range(n), k=draw.randrange(1, 30)) for _ in range(300)] + [draw.choices(range(300), k=draw.randrange(1, 12)) for _ in range(700)]
    rows = [*by_text, [], *odd]
    want = own.tokenizer.decode_batch(rows, skip_special_tokens=False)
    assert own.decoded(rows) == want
    assert any("�" in x for x in want)
    valid = [i for i, x in enumerate(want) if "�" not in x]
    own_decode, own.tokenizer = own.tokenizer, None  # valid bytes need no tokenizer
    try:
        assert own.decoded([rows[i] for i in valid]) == [want[i] for i in valid]
    finally:
        own.tokenizer = own_decode
