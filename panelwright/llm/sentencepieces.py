"""SentencePiece encoding and decoding with the ``tokenizers`` library as the backend.

The model file's protobuf is parsed here (its wire format needs no schema), and the tokenizer is built
again from it: normaliser (the precompiled character map, the dummy prefix, the metaspace mark), the
pieces with their scores (a unigram model; for a BPE model the merges in order of score) and byte
fallback. Batches are encoded with ``THREADS`` threads.

Parity is verified against the ``sentencepiece`` library on whole texts: ``parity`` says that the ids of the whole text are
those of the library. ``round_trip`` says that these ids decode to the text; ``n_chars_decoded`` counts the decoded text.
A text whose ids, put together from its pieces, differ from the library's is encoded again as a whole.

The registered query uses the shipped model, a BPE model with byte fallback; unigram models go the same way without the memo of pieces
(``tests/llm`` builds one).

Null text is empty: no ids. Rows with equal or null ids keep their rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat_text, row_blocks
from .tokens import PieceEncoder, _flat, default_path, metaspace_cuts

THREADS = 2
MARK = "▁"
#: Piece types and model types of the format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(raw: bytes):
    """``(number, value)`` of a protobuf message: varints as int, fixed 32 bits as float, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 1:
            yield key >> 3, raw[at : at + 8]
            at += 8
        elif kind == 2:
            n = varint()
            yield key >> 3, raw[at : at + n]
            at += n
        elif kind == 5:
            yield key >> 3, struct.unpack("<f", raw[at : at + 4])[0]
            at += 4
        else:
            raise ValueError("not a model file")


def parse_model(raw: bytes) -> dict:
    """Pieces ``(text, score, type)`` and the trainer's and normaliser's settings that matter."""
    model = {
        "pieces": [], "type": UNIGRAM, "byte_fallback": False, "unk_id": 0, "charsmap": b"", "add_dummy_prefix": True,
        "remove_extra_whitespaces": True, "escape_whitespaces": True,
    }
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            model["pieces"].append((piece[1].decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
        elif number == 2:
            spec = dict(_fields(value))
            model |= {"type": spec.get(3, UNIGRAM), "byte_fallback": bool(spec.get(35, 0)), "unk_id": spec.get(40, 0)}
        elif number == 3:
            spec = dict(_fields(value))
            names = {2: "charsmap", 3: "add_dummy_prefix", 4: "remove_extra_whitespaces", 5: "escape_whitespaces"}
            model |= {name: spec[k] if k == 2 else bool(spec[k]) for k, name in names.items() if k in spec}
    return model


def merges_of(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """The pairs that make each piece, best scores first; pairs of one piece by the ids of their parts."""
    ids = {text: i for i, (text, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for text, score, kind in pieces:
        if kind != NORMAL or len(text) < 2:
            continue
        for k in range(1, len(text)):
            a, b = ids.get(text[:k]), ids.get(text[k:])
            if a is not None and b is not None:
                found.append((-score, a, b, text[:k], text[k:]))
    found.sort(key=lambda x: x[:3])
    return [x[3:] for x in found]


def build(model: dict):
    """A ``tokenizers`` tokenizer of a parsed model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    pieces = model["pieces"]
    unk = pieces[model["unk_id"]][0]
    if model["type"] == BPE:
        vocab = {text: i for i, (text, _, _) in enumerate(pieces)}
        core = models.BPE(vocab, merges_of(pieces), unk_token=unk, fuse_unk=True, byte_fallback=model["byte_fallback"], cache_capacity=200_000)
    elif model["type"] == UNIGRAM:
        core = models.Unigram([(text, score) for text, score, _ in pieces], model["unk_id"], model["byte_fallback"])
    else:
        raise ValueError("only unigram and BPE models")
    tokenizer = Tokenizer(core)
    steps = []
    if model["charsmap"]:
        steps.append(normalizers.Precompiled(model["charsmap"]))
    if model["remove_extra_whitespaces"]:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model["add_dummy_prefix"]:
        steps.append(normalizers.Prepend(MARK))
    if model["escape_whitespaces"]:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    tail = [decoders.Strip(" ", 1, 0)] if model["add_dummy_prefix"] else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return tokenizer


def cut_is_safe(model: dict) -> bool:
    """Whether no piece runs from another character into a mark, and white space and characters stay as they are."""
    plain = not model["charsmap"] and not model["remove_extra_whitespaces"] and model["add_dummy_prefix"] and model["escape_whitespaces"]
    return plain and all(MARK not in text.lstrip(MARK) for text, _, _ in model["pieces"])


def _piece_bytes(text: str) -> bytes:
    """What a piece adds to a decoded text; a byte piece is written <0x..>."""
    byte = re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", text)
    return bytes([int(byte[1], 16)]) if byte else text.replace(MARK, " ").encode()


class Backend:
    """Tokenizer, reference and the memo of one model file in a Python worker."""

    def __init__(self, path: str, threads: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        self.model = parse_model(open(path, "rb").read())
        self.tokenizer, self.threads = build(self.model), threads
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        self.safe = cut_is_safe(self.model)
        self.memo = PieceEncoder(self._pieces, metaspace_cuts)
        own = [_piece_bytes(text) for text, _, _ in self.model["pieces"]]
        self.sizes = np.fromiter(map(len, own), np.int64, len(own))
        self.starts, self.data = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(own), np.uint8)

    def whole(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts."""
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each piece begins with a space, which stands for the mark that both libraries put first."""
        return np.arange(len(pieces)), *_flat(self.whole([p[1:] for p in pieces]))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end and offsets of the rows."""
        if not self.safe:
            flat, lengths = _flat(self.whole(column.fill_null("").to_pylist()))
            return flat, np.concatenate([[0], np.cumsum(lengths)])
        data, off = flat_text(column)
        full = np.diff(off) > 0
        # the dummy prefix: a space in front of every text that isn't empty
        data = np.insert(data, off[:-1][full], 0x20)
        off = off + np.concatenate([[0], np.cumsum(full)])
        return self.memo.encode(data, off)

    def decoded(self, ids: list[list[int]]) -> list[str]:
        """The texts of ids of the model, from the bytes of their pieces; the tokenizer decodes those whose bytes aren't UTF-8."""
        flat, lengths = _flat(ids)
        size = self.sizes[flat]
        place = np.concatenate([[0], np.cumsum(size)])
        raw = self.data[np.repeat(self.starts[flat] - place[:-1], size) + np.arange(place[-1])].tobytes()
        at, lead, out = place[np.concatenate([[0], np.cumsum(lengths)])].tolist(), self.model["add_dummy_prefix"], []
        for row, a, b in zip(ids, at[:-1], at[1:], strict=True):
            try:
                out.append(raw[a + (lead and raw[a : min(a + 1, b)] == b" ") : b].decode())
            except UnicodeDecodeError:
                out.append(self.tokenizer.decode(row, skip_special_tokens=False))
        return out

    def verified(self, texts: list[str]) -> tuple[list[list[int]], list[bool], list[str]]:
        """Ids of ``texts``, whether they are the library's, and the texts that they decode to."""
        flat, at = self.encode(pa.array(texts, pa.string()))
        flat, at = flat.tolist(), at.tolist()
        ids = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        want = self.reference.encode(texts, num_threads=self.threads)
        wrong = [i for i, (a, b) in enumerate(zip(ids, want, strict=True)) if a != b]
        for i, again in zip(wrong, self.whole([texts[i] for i in wrong]), strict=True):
            ids[i] = again
        same = [True] * len(texts)
        for i in wrong:
            same[i] = ids[i] == want[i]
        return ids, same, self.decoded(ids)


@lru_cache(maxsize=2)
def backend(path: str, threads: int = THREADS) -> Backend:
    return Backend(path, threads)


def encode(docs: DataFrame, path: str | None = None, text: str = "text", into: str = "ids") -> DataFrame:
    """Adds the column ``into`` (array of ids) to ``docs``, keeping all its columns."""
    path = path or default_path("piece_bpe_32k.model")

    @F.arrow_udf("array<int>")
    def ids_of(column: pa.Array) -> pa.Array:
        parts = [pa.array([], pa.list_(pa.int32()))]
        for a, b in row_blocks(column):
            ids, at = backend(path).encode(column.slice(a, b - a))
            parts.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))))
        return pa.concat_arrays(parts)

    return docs.withColumn(into, ids_of(F.col(text)))


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the column ``into`` (text) to ``encoded``; null ids are an empty text."""
    path = path or default_path("piece_bpe_32k.model")

    @F.arrow_udf("string")
    def text_of(column: pa.Array) -> pa.Array:
        tokenizer, out = backend(path).tokenizer, []
        for a in range(0, len(column), 500):
            out += tokenizer.decode_batch([x or [] for x in column.slice(a, 500).to_pylist()], skip_special_tokens=False)
        return pa.array(out, pa.string())

    return encoded.withColumn(into, text_of(F.col(ids)))


_SCHEMA = "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean, n_chars_decoded long"


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_crc32, parity, round_trip, n_chars_decoded)`` of ``docs(doc_id, text)``.

    ``ids_crc32`` is over little-endian unsigned 32-bit ids; ``n_chars_decoded`` are the code points of the
    decoded text.
    """
    path = path or default_path("piece_bpe_32k.model")

    def tasks(batches):
        own = backend(path)
        for batch in batches:
            for a, b in row_blocks(batch.column(1)):
                texts = batch.column(1).slice(a, b - a).fill_null("").to_pylist()
                ids, same, decoded = own.verified(texts)
                crc = [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(list(map(len, ids)), pa.int64()), pa.array(crc, pa.int64()), pa.array(same),
                     pa.array([x == y for x, y in zip(texts, decoded, strict=True)]), pa.array(list(map(len, decoded)), pa.int64())],
                    names=[x.split()[0] for x in _SCHEMA.split(", ")],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tasks, _SCHEMA)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
