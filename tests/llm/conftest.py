from __future__ import annotations

import pytest

@pytest.fixture(scope="session", autouse=True)
def short_training():
    """Few rounds where a test doesn't hold the network's quality."""
    from panelwright.llm import pii

    old = pii.train.__defaults__
    pii.train.__defaults__ = (*old[:-1], 60)
    yield
    pii.train.__defaults__ = old


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, sig string, language string, pii string, n long"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, and columns whose names clash with the operators' own."""
    words = " ".join(f"word{i % 97}x{i}" for i in range(400))
    rows = [
        (1, words, "en", "s"), (2, words, "en", "s"), (3, words.replace("word5x5 ", "changed "), "en", None), (3, words.replace("word5x5 ", "changed "), "en", None),
        (4, None, "en", "s"), (5, "", None, None), (6, " \t\n ", "de", "s"), (7, "one two", "en", "s"), (8, "ONE two", "en", "s"),
        (9, "mail a.b@c.org or +1 (555) 123-4567, 10.0.0.1 card 4111 1111 1111 1111 end", None, "s"), (10, "the and of " * 20_000, "en", "s"),
        (11, "éàü ñandú — 日本語 テキスト", "es", "s"), (None, "the end of a text without an id, which is kept", "en", "s"), (12, "12345 !!! ---", "en", "s"),
    ]
    return spark.createDataFrame([(a, b, c, d, len(b) if b else None, "x", "y", "z", "p", 1) for a, b, c, d in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
