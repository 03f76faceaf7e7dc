"""Tokenizing whole texts through the ``tokenizers`` library, each distinct word once.

A byte-level or metaspace tokenizer never lets a token run from a non-space character into a
following space, so a text can be cut there and the pieces encoded on their own. Pieces repeat
(words do), so a task encodes every distinct piece once and gathers the ids of the rest.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np

from .common import span_hashes

#: Distinct pieces that a Python worker remembers before it starts over; it bounds memory, not results.
MEMO_PIECES = 3_000_000
#: New pieces are kept apart until so many have come, then merged into the sorted table.
RECENT_PIECES = 150_000


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _solid(data: np.ndarray) -> np.ndarray:
    """Bytes that end a character which surely is no white space: ASCII, or two bytes from U+00C0 on."""
    solid = (data > 0x20) & (data < 0x7F)
    solid[1:] |= (data[1:] >= 0x80) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
    return solid


def _spans(cut: np.ndarray, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut[off] = True
    cut[len(data)] = True
    at = np.flatnonzero(cut)
    return at[:-1], at[1:]


def metaspace_cuts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of a metaspace tokenizer: cut at each space after a solid character."""
    n, cut = len(data), np.zeros(len(data) + 1, bool)
    cut[1:n] = (data[1:] == 0x20) & _solid(data)[:-1]
    return _spans(cut, data, off)


def byte_level_cuts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of a byte-level tokenizer, at places where its word pattern always ends a match.

    These are: before a space or line end that follows a solid character; after a line end that
    stands alone between two; between a Latin letter and ASCII punctuation. Elsewhere the text just
    isn't cut.
    """
    n, cut = len(data), np.zeros(len(data) + 1, bool)
    if n:
        solid = _solid(data)
        space = (data == 0x20) | (data == 0x0A)
        cut[1:n] = space[1:] & solid[:-1]
        lower = data | 0x20
        letter = (lower >= 97) & (lower <= 122)
        latin = (data[1:] >= 0x80) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xC9)
        latin &= (data[:-1] != 0xC3) | ((data[1:] != 0x97) & (data[1:] != 0xB7))
        mark = (data > 0x20) & (data < 0x7F) & ~letter & ~((data >= 48) & (data <= 57))
        cut[1:n] |= mark[1:] & letter[:-1]
        cut[2:n] |= mark[2:] & latin[:-1]
        first = np.zeros(n + 1, bool)
        first[off] = True
        starts = ((data > 0x20) & (data < 0x7F)) | ((data >= 0xC3) & (data <= 0xC9))
        cut[2:n] |= (data[1:-1] == 0x0A) & solid[:-2] & starts[2:] & ~first[1 : n - 1]
    return _spans(cut, data, off)


class Memo:
    """Sorted keys with the place of their ids: a large table, and a small one of recent keys."""

    def __init__(self):
        self.keys = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
        self.slots = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of sorted distinct keys, -1 where unknown."""
        out = np.full(len(keys), -1, np.int64)
        for known, slots in zip(self.keys, self.slots, strict=True):
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                out[hit] = slots[at[hit]]
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        new = np.arange(len(self.ends) - 1, len(self.ends) - 1 + len(keys), dtype=np.int32)
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
        self._merge(1, keys, new)
        if len(self.keys[1]) > RECENT_PIECES:
            self._merge(0, self.keys[1], self.slots[1])
            self.keys[1], self.slots[1] = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        return new

    def _merge(self, i: int, keys: np.ndarray, slots: np.ndarray) -> None:
        keys, slots = np.concatenate([self.keys[i], keys]), np.concatenate([self.slots[i], slots])
        order = np.argsort(keys, kind="stable")
        self.keys[i], self.slots[i] = keys[order], slots[order]


class PieceEncoder:
    """Rows of text to ids.

    ``encode_pieces`` gets distinct pieces and returns the order it took them in, all their ids and
    each one's count.
    """

    def __init__(self, encode_pieces: Callable, cuts: Callable):
        self._encode, self._cuts, self._memo = encode_pieces, cuts, Memo()

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end (uint32) and the offsets of the rows in them."""
        s, e = self._cuts(data, off)
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        keys, first, which = np.unique(span_hashes(data, s, e, lower=False), return_index=True, return_inverse=True)
        if len(self._memo.ends) + len(keys) > MEMO_PIECES:
            self._memo = Memo()
        slots = self._memo.find(keys)
        new = np.flatnonzero(slots < 0)
        if len(new):
            raw = data.tobytes()
            pieces = [raw[a:b].decode() for a, b in zip(s[first[new]].tolist(), e[first[new]].tolist(), strict=True)]
            order, ids, lengths = self._encode(pieces)
            new = new[order]
            slots[new] = self._memo.add(keys[new], ids, lengths)
        ends = self._memo.ends
        begin, size = ends[slots][which], (ends[slots + 1] - ends[slots])[which]
        place = np.concatenate([[0], np.cumsum(size)])
        out = self._memo.ids[np.repeat(begin - place[:-1], size) + np.arange(place[-1])]
        return out, place[np.searchsorted(s, off)]


def _byte_characters() -> dict[int, str]:
    """The printable character that a byte-level vocabulary writes for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


def _word_encoder(tokenizer) -> Callable:
    """A word of letters is one match of the byte-level pattern, so the BPE model gets it directly;
    every other piece goes through the whole tokenizer."""
    import regex

    word, characters, model = regex.compile(r" ?\p{L}+"), _byte_characters(), tokenizer.model

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        plain = np.fromiter((word.fullmatch(p) is not None for p in pieces), bool, len(pieces))
        first, others = np.flatnonzero(plain), np.flatnonzero(~plain)
        got = []
        for i in first.tolist():
            got.append([x.id for x in model.tokenize(pieces[i].encode().decode("latin-1").translate(characters))])
        if len(others):
            batch = tokenizer.encode_batch_fast([pieces[i] for i in others.tolist()], add_special_tokens=False)
            got.extend(x.ids for x in batch)
        return np.concatenate([first, others]), *_flat(got)

    return encode


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(lengths.sum())), lengths


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> PieceEncoder:
    """The byte-level BPE tokenizer of a ``tokenizers`` JSON file; strings of special tokens are plain text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return PieceEncoder(_word_encoder(tokenizer), byte_level_cuts)
