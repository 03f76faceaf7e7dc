"""A small recurrent network of one series: a layer of gated memory cells and a linear output, trained by back-propagation through time.

It works on arrays (window, step) of one asset inside a task; assets are groups that Spark deals out.
"""

from __future__ import annotations

import numpy as np

#: Steps of a window, cells, passes over all windows and rate of Adam (fixed values).
LOOKBACK, CELLS, PASSES, RATE = 20, 32, 50, 0.01
#: Windows that training needs at least beyond one lookback (fixed value).
SPARE = 10

Weights = dict[str, np.ndarray]


def fresh(cells: int = CELLS, seed: int = 0) -> Weights:
    """Seeded weights: input, recurrent and bias rows of the four gates side by side, and those of the output."""
    rng, width = np.random.default_rng(seed), 1 / np.sqrt(cells)
    draw = lambda *shape: rng.uniform(-width, width, shape)
    return {"x": draw(4 * cells), "h": draw(cells, 4 * cells), "b": draw(4 * cells), "out": draw(cells), "level": draw(1)}


def _gate(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def run(w: Weights, x: np.ndarray, trace: list | None = None) -> np.ndarray:
    """The prediction after each window's last step; ``trace`` gathers what the way back needs."""
    n, cells = len(x), len(w["out"])
    h, c = np.zeros((n, cells)), np.zeros((n, cells))
    for step in x.T:
        z = step[:, None] * w["x"] + h @ w["h"] + w["b"]
        keep, take, show = (_gate(z[:, k * cells : (k + 1) * cells]) for k in (0, 1, 2))
        new = np.tanh(z[:, 3 * cells :])
        before, held = c, h
        c = keep * before + take * new
        bent = np.tanh(c)
        h = show * bent
        if trace is not None:
            trace.append((step, held, before, keep, take, show, new, bent))
    if trace is not None:
        trace.append(h)
    return h @ w["out"] + w["level"]


def gradient(w: Weights, x: np.ndarray, y: np.ndarray) -> tuple[float, Weights]:
    """Mean squared error of the windows, and its gradient by every weight."""
    trace: list = []
    error = run(w, x, trace) - y
    d = 2 * error / len(y)
    last = trace.pop()
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    grads["out"], grads["level"] = last.T @ d, np.array([d.sum()])
    dh, dc = d[:, None] * w["out"], 0.0
    for step, held, before, keep, take, show, new, bent in reversed(trace):
        dc = dc + dh * show * (1 - bent * bent)
        dz = np.concatenate([dc * before * keep * (1 - keep), dc * new * take * (1 - take), dh * bent * show * (1 - show), dc * take * (1 - new * new)], 1)
        grads["x"] += step @ dz
        grads["h"] += held.T @ dz
        grads["b"] += dz.sum(0)
        dh, dc = dz @ w["h"].T, dc * keep
    return float(error @ error / len(y)), grads


def trained(x: np.ndarray, y: np.ndarray, passes: int = PASSES, cells: int = CELLS, seed: int = 0) -> Weights | None:
    """Weights after ``passes`` steps of Adam over all windows; None if the error isn't a number any more."""
    w = fresh(cells, seed)
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for t in range(1, passes + 1):
        loss, grads = gradient(w, x, y)
        if not np.isfinite(loss):
            return None
        for k, g in grads.items():
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.999 * square[k] + 0.001 * g * g
            w[k] = w[k] - RATE * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
    return w


def returns_ahead(r: np.ndarray, horizon: int, passes: int = PASSES) -> tuple[np.ndarray, float] | None:
    """Predicted returns, each fed back for the next, and the deviation of the fit's errors; None where there are too few returns to learn from."""
    if len(r) < LOOKBACK + SPARE:
        return None
    scale = float(r.std()) or 1.0
    s = r / scale
    x, y = np.lib.stride_tricks.sliding_window_view(s, LOOKBACK)[:-1], s[LOOKBACK:]
    w = trained(x, y, passes)
    if w is None:
        return None
    window = list(s[-LOOKBACK:])
    for _ in range(horizon):
        window.append(float(run(w, np.array(window[-LOOKBACK:])[None])[0]))
    return np.array(window[LOOKBACK:]) * scale, float((run(w, x) - y).std(ddof=1)) * scale
