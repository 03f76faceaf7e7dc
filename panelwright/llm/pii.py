"""Personal data: rule spans, and more from a character-level bidirectional LSTM with a CRF on top.

The rules are the four patterns with their checks (``base_spans``); what they find always stays. The network is
trained in numpy (backpropagation through time, forward-backward for the CRF, Adam) from labelled spans: windows of the
documents around their rule spans, in half of which the spans are exchanged for forms that the rules miss, other windows of
the documents, and generated sentences. The sample of windows is bounded (``SAMPLE``); those of least hash are taken from all
documents. It trains on the driver; its weights (under 0.2 MB) are broadcast. ``quality`` gives precision and recall by
kind on windows that it wasn't trained on.

A text is cut into windows of ``WINDOW`` characters every ``STRIDE``. Every window runs through the network. Viterbi is left
out where the scores prove that "outside" throughout is the best sequence (``_all_outside``), and takes the rest of many batches at once. A position's label is that
of the window in whose middle it lies, and spans are read off the reconciled labels of the whole text, so they may cross windows.

A decoded span is added if it touches no rule span and holds what its kind means: an address with @
and a dot after it; four numbers up to 255; 14 to 19 digits with a valid check digit; 10 to 15 digits
after +, 0 or a bracket. So it adds forms that the rules miss, such as accented addresses, numbers
with other separators, or phone numbers without +.

Null text is empty and has no spans. Offsets are code points, ends exclusive. Repeated ids and null ids keep their rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, row_blocks

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 1152, 1024
HIDDEN, ROUNDS, BATCH, LENGTH = 16, 500, 32, 96
#: Windows of documents in training, and windows that the network takes at once: many, as a step of few takes nearly as long.
SAMPLE, AT_ONCE = 2400, 512
#: Steps whose label scores are one product, and steps whose symbols or bounds are laid out at once.
SCORED, LAID_OUT = 16, 128
#: Bytes of texts whose windows are sorted by length, so that few steps run over the ends of shorter ones.
SORTED_BYTES = 4 << 20
#: Windows whose labels a worker remembers before it starts over; it bounds memory, not results.
REMEMBERED = 200_000

# ---------------------------------------------------------------- rules

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(digits)):
        d = ord(x) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str):
    """An @ with the longest run of local characters before it that starts at the last match's end or later."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARACTERS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            # local characters can't run over this @ again
            done = at + 1
        at = text.find("@", done)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """``(start, kind, end)`` of the rule spans by start, then kind."""
    spans = [(a, 0, b) for a, b in _emails(text)]
    spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m.groups()))]
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGITS.sub("", m[0])) <= 15:
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# ---------------------------------------------------------------- labelled sentences

_SYLLABLES = "the an er in on re de la es en un que ment tion au eu st nd ing ch ver lo sa mi ko tu ra né à ü ß ç".split()


def _word(rng) -> str:
    w = "".join(rng.choice(_SYLLABLES, rng.integers(1, 4)))
    return w.capitalize() if rng.random() < 0.15 else w


def _digits(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _card(rng, sep: str) -> str:
    body = _digits(rng, int(rng.integers(14, 17)) - 1)
    whole = next(body + str(d) for d in range(10) if luhn(body + str(d)))
    return sep.join(whole[i : i + 4] for i in range(0, len(whole), 4))


def _example(rng, kind: int) -> str:
    if kind == 0:
        local = _word(rng) + str(rng.choice(["", ".", "_", "+", "%", "-"])) + _word(rng) + _digits(rng, int(rng.integers(0, 3)))
        more = "".join(_word(rng) for _ in range(int(rng.integers(0, 4)))) if rng.random() < 0.3 else ""
        if rng.random() < 0.15:
            more += str(rng.choice(list("abcxyz"))) * int(rng.integers(3, 60))
        return f"{local.strip('._+%-') or 'x'}@{_word(rng)}{rng.choice(['', '-' + _word(rng)])}{more}.{rng.choice(['com', 'org', 'de', 'example', 'net'])}"
    if kind == 1:
        return ".".join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        return _card(rng, str(rng.choice(["", " ", "-", "."])))
    groups = [_digits(rng, int(n)) for n in rng.integers(2, 5, 3)]
    sep = str(rng.choice([" ", "-", ".", ""]))
    start = str(rng.choice(["+", "+", "00", "0", "("]))
    lead = _digits(rng, int(rng.integers(1, 4)))
    return ("(0" + lead + ") " if start == "(" else start + lead + sep) + sep.join(groups)


def _other(rng) -> str:
    """Figures that are no personal data."""
    n = rng.integers
    return str(
        rng.choice([
            f"{n(1900, 2030)}-{n(1, 13):02d}-{n(1, 29):02d}", f"{n(1, 24)}:{n(0, 60):02d}", f"{n(0, 999)}.{n(0, 99):02d}", f"{n(1, 99)},{n(0, 999):03d}",
            f"v{n(0, 9)}.{n(0, 20)}.{n(0, 9)}", _digits(rng, int(n(1, 9))), f"{n(1, 29)}/{n(1, 13)}/{n(1990, 2030)}", f"#{n(1, 99999)}",
            f"@{_word(rng)}", f"{n(2, 9)} x {n(2, 99)}", f"{n(1, 100)}%", f"CC BY-NC {n(1, 5)}.0",
        ])
    )


def labelled_examples(n: int, seed: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and labels (0 outside, 1 + 2k first, 2 + 2k further character of kind k) of ``n`` windows."""
    rng = np.random.default_rng(seed)
    x, y = np.zeros((n, length), np.int64), np.zeros((n, length), np.int64)
    for i in range(n):
        text, labels = "", []
        while len(text) < length:
            draw = rng.random()
            kind = int(rng.integers(0, 4)) if draw < 0.22 else -1
            piece = _example(rng, kind) if kind >= 0 else _other(rng) if draw < 0.38 else _word(rng)
            text += piece
            labels += [1 + 2 * kind] + [2 + 2 * kind] * (len(piece) - 1) if kind >= 0 else [0] * len(piece)
            gap = str(rng.choice([" ", " ", " ", ", ", ". ", "\n", ": "]))
            text += gap
            labels += [0] * len(gap)
        x[i], y[i] = symbols(text[:length]), labels[:length]
    return x, y


def symbols(text: str) -> np.ndarray:
    """Code points up to 127 as they are, letters beyond as 128, all else as 0."""
    parts = []
    for k in range(0, len(text), 1 << 20):
        points = np.frombuffer(text[k : k + (1 << 20)].encode("utf-32-le", "surrogatepass"), np.uint32)
        parts.append(np.where(points < 128, points, np.where((points >= 0xC0) & (points < 0x2000), 128, 0)).astype(np.uint8))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def exchanged(text: str, spans: list[Span], rng) -> tuple[str, list[Span]]:
    """``text`` with each span replaced by a generated one of its kind, and the new spans."""
    parts, out, done, shift = [], [], 0, 0
    for a, k, b in spans:
        if a < done:
            continue
        new = _example(rng, k)
        parts += [text[done:a], new]
        out.append((a + shift, k, a + shift + len(new)))
        shift += len(new) - (b - a)
        done = b
    return "".join([*parts, text[done:]]), out


def window_of(text: str, spans: list[Span], at: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and labels of the window of ``text`` from ``at`` on."""
    x, y = np.full(length, 10, np.uint8), np.zeros(length, np.uint8)
    own = symbols(text[at : at + length])
    x[: len(own)] = own
    for a, k, b in spans:
        lo, hi = max(a - at, 0), min(b - at, length)
        if lo < hi:
            y[lo:hi] = 2 + 2 * k
            if a >= at:
                y[lo] = 1 + 2 * k
    return x, y


def corpus_windows(docs: DataFrame, n: int = SAMPLE, text: str = "text", seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and labels of up to ``n`` windows of ``docs``: around rule spans as they are and with the spans exchanged, and
    as many elsewhere.

    Texts go in parts of 4,000 characters. By the hash of a part, of ``total`` texts about 40 n are searched for spans and 4 n taken
    without one, whatever the size of ``docs``; of the windows found, those of least hash are kept.
    """
    total = max(1, docs.count())

    def tasks(batches):
        for batch in batches:
            for a, b in row_blocks(batch.column(0)):
                hashes, xs, ys = [], [], []
                for whole in batch.column(0).slice(a, b - a).to_pylist():
                    for part in (whole[k : k + 4000] for k in range(0, len(whole or ""), 4000)):
                        rank = zlib.crc32(part.encode("utf-8", "surrogatepass")) / 2**32 * total
                        if rank >= 40 * n:
                            continue
                        spans, taken = base_spans(part), []
                        if not spans and rank >= 4 * n:
                            continue
                        rng = np.random.default_rng([seed, zlib.crc32(part.encode("utf-8", "surrogatepass"))])
                        for at, _, _ in spans[:2]:
                            taken.append((part, spans, max(0, at - int(rng.integers(5, LENGTH // 2)))))
                            other, new = exchanged(part, spans, rng)
                            at = min(x for x, _, _ in new)
                            taken.append((other, new, max(0, at - int(rng.integers(5, LENGTH // 2)))))
                        if rank < 4 * n:
                            taken.append((part, spans, int(rng.integers(0, max(1, len(part) - LENGTH)))))
                        for own, own_spans, at in taken:
                            x, y = window_of(own, own_spans, at)
                            xs.append(x.tobytes())
                            ys.append(y.tobytes())
                            hashes.append(zlib.crc32(xs[-1]))
                if xs:
                    yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(xs), pa.array(ys)], names=["h", "x", "y"])

    found = docs.filter(F.col(text).isNotNull()).select(text).mapInArrow(tasks, "h long, x binary, y binary")
    found = materialise(found.dropDuplicates(["h", "x"]), "pii-windows")
    has = F.col("y") != F.lit(bytes(LENGTH))
    parts = [found.filter(has if spans else ~has).orderBy("h", "x").limit(n // 2) for spans in (True, False)]
    rows = parts[0].unionByName(parts[1]).collect()
    stack = lambda name: np.array([np.frombuffer(r[name], np.uint8) for r in rows]).reshape(-1, LENGTH)
    return stack("x").astype(np.int64), stack("y").astype(np.int64)


# ---------------------------------------------------------------- network

LABELS, SYMBOLS = 1 + 2 * len(KINDS), 129
_FORBIDDEN = -1e4


def _mask() -> np.ndarray:
    """An inside label follows its own first or inside label only."""
    m = np.zeros((LABELS, LABELS))
    for j in range(2, LABELS, 2):
        m[:, j] = _FORBIDDEN
        m[[j - 1, j], j] = 0
    return m


def _bend(z: np.ndarray) -> np.ndarray:
    """In place: z / (1 + abs(z)), the network's squashing function; a tenth of a tanh's time. A gate is (1 + it) / 2."""
    z /= 1 + np.abs(z)
    return z


def _gates(z: np.ndarray, h: int) -> np.ndarray:
    """In place: the first three parts as gates between 0 and 1, the last between -1 and 1."""
    _bend(z)
    z[:, : 3 * h] += 1
    z[:, : 3 * h] *= 0.5
    return z


def _run(x: np.ndarray, table: np.ndarray, rec: np.ndarray, keep: bool):
    """Hidden states (time, row, unit) of one direction over symbols ``x`` (row, time)."""
    n, steps, h = len(x), x.shape[1], rec.shape[0]
    out = np.zeros((steps + 1, n, h), table.dtype)
    cell = np.zeros((n, h), table.dtype)
    gates, cells = [], [cell]
    for t in range(steps):
        z = _gates(table[x[:, t]] + out[t] @ rec, h)
        cell = z[:, h : 2 * h] * cell + z[:, :h] * z[:, 3 * h :]
        out[t + 1] = z[:, 2 * h : 3 * h] * _bend(cell.copy())
        if keep:
            gates.append(z)
            cells.append(cell)
    return out, gates, cells


def _run_back(x, rec, out, gates, cells, d_out):
    """Gradients of one direction's symbol table and recurrent weights."""
    h = rec.shape[0]
    n, steps = x.shape
    dzs = np.empty((steps, n, 4 * h), rec.dtype)
    dh, dc = np.zeros_like(out[0]), np.zeros_like(out[0])
    for t in range(steps - 1, -1, -1):
        z, c = gates[t], cells[t + 1]
        i, f, o, g = z[:, :h], z[:, h : 2 * h], z[:, 2 * h : 3 * h], z[:, 3 * h :]
        dh = dh + d_out[t]
        tc = _bend(c.copy())
        dc = dc + dh * o * (1 - np.abs(tc)) ** 2
        # the slope of z / (1 + abs(z)) is (1 - abs(it))^2, and half of that for a gate
        slope = (1 - np.abs(2 * z - 1)) ** 2 / 2
        slope[:, 3 * h :] = (1 - np.abs(g)) ** 2
        dzs[t] = slope * np.concatenate([dc * g, dc * cells[t], dh * tc, dc * i], 1)
        dh, dc = dzs[t] @ rec.T, dc * f
    flat = dzs.reshape(-1, 4 * h)
    one_hot = np.zeros((SYMBOLS, steps * n), rec.dtype)
    one_hot[x.T.ravel(), np.arange(steps * n)] = 1
    return one_hot @ flat, out[:-1].reshape(-1, h).T @ flat


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))


def _crf(emit: np.ndarray, trans: np.ndarray, y: np.ndarray):
    """Mean loss and the gradients by emissions (time, row, label) and transitions."""
    steps, n, k = emit.shape
    fwd, bwd = np.zeros_like(emit), np.zeros_like(emit)
    start = np.zeros(k, emit.dtype)
    start[2::2] = _FORBIDDEN
    fwd[0] = emit[0] + start
    for t in range(1, steps):
        fwd[t] = _lse(fwd[t - 1][:, :, None] + trans, 1) + emit[t]
    for t in range(steps - 2, -1, -1):
        bwd[t] = _lse(trans + (emit[t + 1] + bwd[t + 1])[:, None, :], 2)
    norm = _lse(fwd[-1], 1)
    d_emit = np.exp(fwd + bwd - norm[None, :, None])
    rows = np.arange(n)
    d_trans = np.zeros_like(trans)
    gold = emit[0][rows, y[:, 0]].sum()
    for t in range(1, steps):
        pair = np.exp(fwd[t - 1][:, :, None] + trans + (emit[t] + bwd[t])[:, None, :] - norm[:, None, None])
        d_trans += pair.sum(0)
        np.add.at(d_trans, (y[:, t - 1], y[:, t]), -1)
        gold += (trans[y[:, t - 1], y[:, t]] + emit[t][rows, y[:, t]]).sum()
    for t in range(steps):
        d_emit[t][rows, y[:, t]] -= 1
    return (norm.sum() - gold) / n, d_emit / n, d_trans / n


#: Weights of the last trainings of this process, by a digest of their windows and settings.
_TRAINED: dict[str, dict[str, np.ndarray]] = {}


def train(windows: tuple[np.ndarray, np.ndarray] | None = None, seed: int = 11, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Weights of the tagger, from generated sentences and labelled ``windows`` (see ``corpus_windows``)."""
    key = hashlib.sha256(repr((seed, rounds)).encode() + b"".join(a.tobytes() for a in windows or ())).hexdigest()
    if key in _TRAINED:
        return _TRAINED[key]
    rng = np.random.default_rng(seed)
    h = HIDDEN
    w = {
        "ft": rng.normal(0, 0.3, (SYMBOLS, 4 * h)), "fr": rng.normal(0, 0.25, (h, 4 * h)),
        "bt": rng.normal(0, 0.3, (SYMBOLS, 4 * h)), "br": rng.normal(0, 0.25, (h, 4 * h)),
        "out": rng.normal(0, 0.3, (2 * h, LABELS)), "bias": np.zeros(LABELS), "trans": np.zeros((LABELS, LABELS)),
    }
    for name in ("ft", "bt"):
        w[name][:, h : 2 * h] += 1.0
    w = {k: v.astype(np.float32) for k, v in w.items()}
    mask, mean, var = _mask().astype(np.float32), {k: 0.0 for k in w}, {k: 0.0 for k in w}
    xs, ys = labelled_examples(1200, seed)
    if windows is not None and len(windows[0]):
        xs, ys = np.concatenate([xs, windows[0]]), np.concatenate([ys, windows[1]])
    for step in range(1, rounds + 1):
        pick = rng.integers(0, len(xs), BATCH)
        x, y = xs[pick], ys[pick]
        back = x[:, ::-1]
        fo, fg, fc = _run(x, w["ft"], w["fr"], True)
        bo, bg, bc = _run(back, w["bt"], w["br"], True)
        state = np.concatenate([fo[1:], bo[1:][::-1]], 2)
        _, d_emit, d_trans = _crf(state @ w["out"] + w["bias"], w["trans"] + mask, y)
        d_state = d_emit @ w["out"].T
        grads = {"out": np.einsum("tnh,tnk->hk", state, d_emit), "bias": d_emit.sum((0, 1)), "trans": d_trans * (mask == 0)}
        grads["ft"], grads["fr"] = _run_back(x, w["fr"], fo, fg, fc, d_state[:, :, :h])
        grads["bt"], grads["br"] = _run_back(back, w["br"], bo, bg, bc, d_state[::-1, :, h:])
        rate = 0.02 * (1 - 0.9 * step / rounds)
        for k, g in grads.items():
            mean[k] = 0.9 * mean[k] + 0.1 * g
            var[k] = 0.99 * var[k] + 0.01 * g * g
            w[k] = w[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-8)
    w["trans"] = w["trans"] + mask
    while len(_TRAINED) > 3:
        del _TRAINED[next(iter(_TRAINED))]
    _TRAINED[key] = {k: v.astype(np.float32) for k, v in w.items()}
    return _TRAINED[key]


def emissions(x: np.ndarray, w: dict[str, np.ndarray], length: np.ndarray | None = None) -> np.ndarray:
    """Scores (time, label, row) of symbol windows ``x`` (row, time); beyond a row's ``length`` there is only outside, and the
    backward direction starts at that length, so a row's scores don't depend on the others.

    Gates, and then both directions, come first and a window's units last, so that a symbol's part of a table is copied at once and
    every operation runs over one stretch of memory.
    """
    n, steps = x.shape
    h = w["fr"].shape[0]
    half, one = np.float32(0.5), np.float32(1)  # the states are kept twice as large
    table = np.concatenate([w[k].reshape(SYMBOLS, 4, h).transpose(1, 0, 2) for k in ("ft", "bt")], 1).astype(np.float32)
    rec = np.stack([w[k].reshape(h, 4, h).transpose(1, 0, 2) for k in ("fr", "br")], 1).astype(np.float32) * half
    heads = np.stack([w["out"][:h].T, w["out"][h:].T]).astype(np.float32) * half
    states, cell, new = np.zeros((2, SCORED, n, h), np.float32), np.zeros((2, n, h), np.float32), np.empty((2, n, h), np.float32)
    z, size = np.empty((4, 2, n, h), np.float32), np.empty((4, 2, n, h), np.float32)
    enter, forget, leave, fresh = z
    gates, looked_up, every = z[:3], size.reshape(4, 2 * n, h), [states[:, j] for j in range(SCORED)]
    emit, state = np.empty((steps, LABELS, n), np.float32), every[-1]
    emit[:] = w["bias"][:, None]
    first = steps if length is None else int(length.min(initial=steps))
    for t in range(steps):
        if t % LAID_OUT == 0:
            to = min(t + LAID_OUT, steps)
            symbol = np.concatenate([x[:, t:to].T, x[:, steps - to : steps - t].T[::-1].astype(np.intp) + SYMBOLS], 1)
        np.matmul(state, rec, out=z)
        table.take(symbol[t % LAID_OUT], 1, looked_up, "clip")
        np.add(z, size, out=z)
        np.abs(z, out=size)
        np.add(size, one, out=size)
        np.divide(z, size, out=z)
        np.add(gates, one, out=gates)
        np.multiply(cell, forget, out=cell)
        np.multiply(enter, fresh, out=new)
        np.add(cell, new, out=cell)
        np.multiply(cell, half, out=cell)
        np.abs(cell, out=new)
        np.add(new, one, out=new)
        np.divide(cell, new, out=new)
        state = every[t % SCORED]
        np.multiply(new, leave, out=state)
        if steps - 1 - t >= first:
            alive = (steps - 1 - t < length).astype(np.float32)[:, None]
            state[1] *= alive
            cell[1] *= alive
        if t % SCORED == SCORED - 1 or t == steps - 1:
            k, at = t % SCORED + 1, t - t % SCORED
            scores = np.matmul(heads, states.reshape(2, SCORED * n, h).transpose(0, 2, 1)[:, :, : k * n]).reshape(2, LABELS, k, n).transpose(0, 2, 1, 3)
            emit[at : at + k] += scores[0]
            emit[steps - at - k : steps - at] += scores[1, ::-1]
    if length is not None:
        emit[first:, 1:] += _FORBIDDEN * (np.arange(first, steps)[:, None] >= length)[:, None, :]
    return emit


def _all_outside(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Rows in which no sequence can score more than outside throughout.

    ``gain`` bounds what the part of a sequence since it last left "outside" has over staying outside, for each kind: a first
    label adds its score over outside and the best transition to a first label, a further one its score over outside and the
    transition from its own kind. If it stays below 0 everywhere, with the best way back outside, no sequence wins.
    """
    stay = trans[0, 0]
    first, further = np.arange(1, LABELS, 2), np.arange(2, LABELS, 2)
    into, out = max(0.0, float(trans[:, first].max() - stay)), max(0.0, float(trans[1:, 0].max() - stay))
    step = (np.maximum(trans[first, further], trans[further, further]) - stay)[:, None]
    gain = np.full((len(first), emit.shape[2]), -np.inf, np.float32)
    top, base = gain.copy(), np.zeros(emit.shape[2], np.float32)
    for k in range(0, len(emit), LAID_OUT):
        scores = emit[k : k + LAID_OUT]
        on, anew = scores[:, 2::2] - scores[:, :1], scores[:, 1::2] - scores[:, :1]
        on += step
        anew += np.float32(into)
        for longer, begun in zip(on, anew, strict=True):
            np.add(gain, longer, out=gain)
            np.add(begun, base, out=begun)
            np.maximum(gain, begun, out=gain)
            np.maximum.reduce(gain, 0, None, base, initial=0)
            np.maximum(top, gain, out=top)
    return top.max(0) + out < -1e-3


def decode(x: np.ndarray, w: dict[str, np.ndarray], length: np.ndarray | None = None) -> np.ndarray:
    """Best label sequences (row, time) of symbol windows ``x``."""
    labels = np.zeros(x.shape, np.uint8)
    left, emit = undecided(x, w, length)
    if len(left):
        labels[left] = _viterbi(emit, w["trans"])
    return labels


def undecided(x: np.ndarray, w: dict[str, np.ndarray], length: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` that may be more than outside throughout, and their scores."""
    emit = emissions(x, w, length)
    left = np.flatnonzero(~_all_outside(emit, w["trans"]))
    return left, np.take(emit, left, 2)


def _best_of(parts: list[np.ndarray], trans: np.ndarray) -> np.ndarray:
    """Best label sequences (row, time) of all ``parts`` (time, label, row) together; outside after a shorter part's end."""
    emit = np.zeros((max(map(len, parts)), LABELS, sum(p.shape[2] for p in parts)), np.float32)
    at = 0
    for p in parts:
        emit[: len(p), :, at : at + p.shape[2]] = p
        emit[len(p) :, 1:, at : at + p.shape[2]] = _FORBIDDEN
        at += p.shape[2]
    return _viterbi(emit, trans)


def _viterbi(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best label sequences (row, time) of scores (time, label, row); at ties the first label before.

    The way forward keeps scores only; the way back finds the label before from them, for the labels that it passes.
    """
    steps, k, n = emit.shape
    score, moves, tried = emit.copy(), np.ascontiguousarray(trans)[:, :, None], np.empty((k, k, n), emit.dtype)
    score[0, 2::2] += _FORBIDDEN
    for t in range(1, steps):
        np.add(score[t - 1][:, None], moves, out=tried)
        score[t] += np.maximum.reduce(tried, 0)
    labels = np.zeros((steps, n), np.uint8)
    labels[-1] = score[-1].argmax(0)
    for t in range(steps - 1, 0, -1):
        labels[t - 1] = (score[t - 1] + trans[:, labels[t]]).argmax(0)
    return labels.T


def quality(x: np.ndarray, y: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, tuple[float, float]]:
    """Precision and recall of whole spans by kind, for windows ``x`` with labels ``y``; spans cut by a window's ends don't count."""
    found = decode(x, w)
    right, said, true = np.zeros(4), np.zeros(4), np.zeros(4)
    for got, want in zip(found, y, strict=True):
        got, want = ({s for s in _spans_of(z.astype(np.int64)) if s[0] > 0 and s[2] < len(z)} for z in (got, want))
        for spans, count in ((got & want, right), (got, said), (want, true)):
            for _, k, _ in spans:
                count[k] += 1
    return {kind: (float(right[k] / max(said[k], 1)), float(right[k] / max(true[k], 1))) for k, kind in enumerate(KINDS)}


# ---------------------------------------------------------------- whole texts


def window_starts(n: int) -> np.ndarray:
    """Starts of the windows over ``n`` characters; the last one reaches the end."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


#: Labels (empty: all outside) of windows that this process has decoded, by a 128-bit digest of weights and symbols.
_DECODED: dict[bytes, bytes] = {}


def _labels_of(texts: list[str], w: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Reconciled labels of whole texts. Windows of about equal length run together, ``AT_ONCE`` of them, equal ones once."""
    whole = [symbols(t) for t in texts]
    out = [np.zeros(len(s), np.uint8) for s in whole]
    name = hashlib.blake2b(w["out"].tobytes() + w["trans"].tobytes(), digest_size=16).digest()
    windows = [(i, b, s[b : b + WINDOW]) for i, s in enumerate(whole) for b in window_starts(len(s)).tolist() if len(s)]
    keys = [hashlib.blake2b(x.tobytes(), digest_size=16, key=name).digest() for _, _, x in windows]
    if len(_DECODED) > REMEMBERED:
        _DECODED.clear()
    new = {k: x for k, (_, _, x) in zip(keys, windows, strict=True) if k not in _DECODED}
    order = sorted(new, key=lambda k: len(new[k]))
    parts, held = [], []
    for at in range(0, len(order), AT_ONCE):
        own = order[at : at + AT_ONCE]
        length = np.array([len(new[k]) for k in own])
        x = np.full((len(own), length[-1] + 1), 10, np.uint8)
        for row, k in zip(x, own, strict=True):
            row[: len(new[k])] = new[k]
        left, emit = undecided(x, w, length)
        _DECODED.update(dict.fromkeys(own, b""))
        parts.append(emit)
        held += [own[r] for r in left.tolist()]
        if held and (len(held) >= AT_ONCE // 2 or at + AT_ONCE >= len(order)):
            for k, labels in zip(held, _best_of(parts, w["trans"]), strict=True):
                _DECODED[k] = labels[: len(new[k])].tobytes() if labels.any() else b""
            parts, held = [], []
    side = (WINDOW - STRIDE) // 2
    for (i, b, x), k in zip(windows, keys, strict=True):
        if _DECODED[k]:
            lo, hi = (0 if b == 0 else side), (len(x) if b + len(x) >= len(whole[i]) else WINDOW - side)
            out[i][b + lo : b + hi] = np.frombuffer(_DECODED[k], np.uint8)[lo:hi]
    return out


def _spans_of(labels: np.ndarray) -> list[Span]:
    """Spans of a label sequence; an inside label with nothing before it starts a span as well."""
    if not labels.any():
        return []
    at = np.flatnonzero(labels)
    own = labels[at].astype(np.int64)
    kind, apart = (own + 1) // 2, np.diff(at) > 1
    starts = np.concatenate([[True], apart | (own[1:] % 2 == 1) | (kind[1:] != kind[:-1])])
    ends = np.append(starts[1:], True)
    return [(a, k - 1, b + 1) for a, b, k in zip(at[starts].tolist(), at[ends].tolist(), kind[starts].tolist(), strict=True)]


def _holds(kind: int, part: str) -> bool:
    digits = _DIGITS.sub("", part)
    if any(x.isspace() and x != " " for x in part):
        return False
    if kind == 0:
        local, at, domain = part.partition("@")
        return bool(at and local and " " not in part and "@" not in domain and re.search(r"\w\.\w", domain))
    if kind == 1:
        parts = re.split(r"[^0-9]+", part)
        return len(parts) == 4 and all(p and _small(p) for p in parts)
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[0-9 .\-/]+", part) is not None
    return 10 <= len(digits) <= 15 and part[0] in "+0(" and re.fullmatch(r"[+0-9 ().\-/]+", part) is not None


def widened(kind: int, text: str, a: int, b: int) -> tuple[int, int]:
    """A decoded span without marks around it, carried on to the ends of the token that it begins and ends in."""
    while a < b and text[b - 1] in " .,;:\n":
        b -= 1
    while a < b and text[a] in " .,;:\n":
        a += 1
    if a == b:
        return a, b
    inside = (lambda c: c.isalnum() or c in "._%+-") if kind == 0 else str.isdigit
    while a > 0 and inside(text[a - 1]):
        a -= 1
    if kind == 3 and a > 0 and text[a - 1] in "+(":
        a -= 1
    while b < len(text) and (text[b].isdigit() or kind == 0 and (text[b].isalnum() or text[b] in ".-" and text[b + 1 : b + 2].isalnum())):
        b += 1
    return a, b


def find_spans(texts: list[str], w: dict[str, np.ndarray]) -> list[tuple[list[Span], list[Span]]]:
    """Rule spans, and all spans, of each text. A decoded span is added if it holds what its kind must and, where it touches rule spans, is larger
    than these: an address whose name the rules only know the end of has both spans."""
    out = []
    for text, labels in zip(texts, _labels_of(texts, w), strict=True):
        base, more = base_spans(text), set()
        for a, k, b in _spans_of(labels):
            a, b = widened(k, text, a, b)
            met = [(c, e) for c, _, e in base if c < b and a < e]
            if a < b and _holds(k, text[a:b]) and all(a <= c and e <= b and (a, b) != (c, e) for c, e in met):
                more.add((a, k, b))
        out.append((base, sorted([*base, *more])))
    return out


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each run of overlapping spans replaced by the first one's kind in brackets."""
    parts, done = [], 0
    end = 0
    for a, k, b in spans:
        if a >= end:
            parts += [text[done:a], f"[{KINDS[k].upper()}]"]
        end = max(end, b)
        done = end
    return "".join([*parts, text[done:]])


_FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"


def with_personal_data(docs: DataFrame, text: str = "text", into: str = "pii", redacted: bool = True, weights: dict | None = None) -> DataFrame:
    """Adds the struct column ``into`` (counts, digest, spans, redacted text or null) to ``docs``, keeping all its columns.

    Without ``weights`` (see ``train``) the network is trained from ``docs``.
    """
    weights = weights or train(corpus_windows(docs, text=text))
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = [x.split()[0] for x in _FOUND.split(", ")]

    @F.arrow_udf(_FOUND)
    def find(column: pa.Array) -> pa.Array:
        column = pc.fill_null(column, "")
        n = len(column)
        counts = np.zeros((4, n), np.int64)
        digests, spans = [hashlib.sha256(b"").hexdigest()] * n, [""] * n
        after = [pa.array([], pa.string())]
        for lo, hi in row_blocks(column, SORTED_BYTES):
            texts = column.slice(lo, hi - lo).to_pylist()
            for i, (base, every) in enumerate(find_spans(texts, shared.value), lo):
                if not every:
                    continue
                for _, kind, _ in base:
                    counts[kind, i] += 1
                digests[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                spans[i] = joined(every)
                if redacted:
                    texts[i - lo] = redact(texts[i - lo], every)
            after.append(pa.array(texts if redacted else [None] * len(texts), pa.string()))
        return pa.StructArray.from_arrays([*map(pa.array, counts), pa.array(digests), pa.array(spans), pa.concat_arrays(after)], names=names)

    return docs.withColumn(into, find(F.col(text)))


def personal_data(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``; the counts are of rule spans."""
    found = with_personal_data(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), redacted=False)
    return found.select("doc_id", *(f"pii.{x.split()[0]}" for x in _FOUND.split(", ")[:-1]))


def op2_pii_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
