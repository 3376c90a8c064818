"""A bidirectional gated recurrent network over bytes, in numpy.

Each direction's input weights are one table row per byte, so the input
product is a look-up. Training is by backpropagation through time with Adam.
"""

from __future__ import annotations

import numpy as np

#: Symbol that fills a window after its text's end.
PAD = 0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def init(classes: int, hidden: int, seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    f = np.float32
    return {
        "table": (r.standard_normal((2, 256, 3 * hidden)) * 0.3).astype(f),
        "rec": (r.standard_normal((2, hidden, 3 * hidden)) / np.sqrt(hidden)).astype(f),
        "bias": np.zeros((2, 1, 3 * hidden), f),
        "out": (r.standard_normal((2 * hidden, classes)) / np.sqrt(2 * hidden)).astype(f),
        "out_bias": np.zeros(classes, f),
    }


def states(p: dict[str, np.ndarray], windows: np.ndarray, lengths: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States [width, rows, 2 * hidden] at every position; ``keep`` gets what training needs.

    A direction's state stays 0 on padding, so the backward one starts at the text's end.
    """
    rows, width = windows.shape
    hidden = p["rec"].shape[1]
    out = np.empty((width, rows, 2 * hidden), np.float32)
    h = np.zeros((2, rows, hidden), np.float32)
    x = np.empty((2, rows, 3 * hidden), np.float32)
    a = np.empty_like(x)
    short = int(lengths.min())
    columns = np.ascontiguousarray(windows.T)
    for t in range(width):
        back = width - 1 - t
        np.take(p["table"][0], columns[t], axis=0, out=x[0], mode="clip")
        np.take(p["table"][1], columns[back], axis=0, out=x[1], mode="clip")
        np.matmul(h, p["rec"], out=a)
        a += p["bias"]
        gates = _sigmoid(x[:, :, : 2 * hidden] + a[:, :, : 2 * hidden])
        z, r = gates[:, :, :hidden], gates[:, :, hidden:]
        inner = a[:, :, 2 * hidden :]
        new = r * inner
        new += x[:, :, 2 * hidden :]
        np.tanh(new, out=new)
        before = h
        h = before - new
        h *= z
        h += new
        live = None
        if t >= short or back >= short:
            live = np.stack([t < lengths, back < lengths])[:, :, None]
            h *= live
        out[t, :, :hidden] = h[0]
        out[back, :, hidden:] = h[1]
        if keep is not None:
            keep.append((before, z, r, inner.copy(), new, live))
    return out


def prepare(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Weights laid out for ``predict``: gates apart from candidates, both tables in one, halves of the sigmoids folded in."""
    hidden = p["rec"].shape[1]
    table = p["table"].copy()
    table[:, :, : 2 * hidden] += p["bias"][:, :, : 2 * hidden]
    table = table.reshape(-1, 3 * hidden)
    f = np.float32
    return {
        "gate_table": np.ascontiguousarray(table[:, : 2 * hidden] * 0.5, f),
        "new_table": np.ascontiguousarray(table[:, 2 * hidden :], f),
        "gate_rec": np.ascontiguousarray(p["rec"][:, :, : 2 * hidden] * 0.5, f),
        "new_rec": np.ascontiguousarray(p["rec"][:, :, 2 * hidden :] * 0.5, f),
        "new_bias": np.ascontiguousarray(p["bias"][:, :, 2 * hidden :] * 0.5, f),
        "out": np.ascontiguousarray(p["out"].reshape(2, hidden, -1), f),
        "out_bias": p["out_bias"],
    }


def predict(w: dict[str, np.ndarray], windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Class probabilities [width, rows, classes] of every position, with weights from ``prepare``."""
    rows, width = windows.shape
    hidden = w["new_rec"].shape[1]
    classes = len(w["out_bias"])
    columns = np.ascontiguousarray(windows.T).astype(np.intp)
    logits = np.empty((width, rows, classes), np.float32)
    logits[:] = w["out_bias"]
    h = np.zeros((2, rows, hidden), np.float32)
    at = np.empty((2, rows), np.intp)
    gates, part = np.empty((2, rows, 2 * hidden), np.float32), np.empty((2, rows, 2 * hidden), np.float32)
    update, reset = np.empty_like(h), np.empty_like(h)
    new, inner = np.empty_like(h), np.empty_like(h)
    short = int(lengths.min())
    for t in range(width):
        back = width - 1 - t
        at[0] = columns[t]
        np.add(columns[back], 256, out=at[1])
        np.take(w["gate_table"], at, axis=0, out=gates, mode="clip")
        np.take(w["new_table"], at, axis=0, out=new, mode="clip")
        np.matmul(h, w["gate_rec"], out=part)
        gates += part
        np.tanh(gates, out=gates)
        gates += 1
        np.matmul(h, w["new_rec"], out=inner)
        inner += w["new_bias"]
        np.copyto(reset, gates[:, :, hidden:])
        inner *= reset
        new += inner
        np.tanh(new, out=new)
        np.copyto(update, gates[:, :, :hidden])
        update *= 0.5
        h -= new
        h *= update
        h += new
        if t >= short or back >= short:
            h *= np.stack([t < lengths, back < lengths])[:, :, None]
        scores = np.matmul(h, w["out"])
        logits[t] += scores[0]
        logits[back] += scores[1]
    logits -= logits.max(axis=2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=2, keepdims=True)
    return logits


def gradients(p: dict[str, np.ndarray], windows: np.ndarray, lengths: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross entropy over all positions that hold text."""
    rows, width = windows.shape
    hidden = p["rec"].shape[1]
    kept: list = []
    top = states(p, windows, lengths, kept)
    logits = top @ p["out"] + p["out_bias"]
    logits -= logits.max(axis=2, keepdims=True)
    prob = np.exp(logits)
    prob /= prob.sum(axis=2, keepdims=True)
    prob[:, np.arange(rows), label] -= 1
    prob *= (np.arange(width)[:, None] < lengths)[:, :, None] / max(1, int(lengths.sum()))
    prob = prob.astype(np.float32)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["out"] = np.einsum("trh,trc->hc", top, prob, optimize=True)
    g["out_bias"] = prob.sum(axis=(0, 1))
    d_top = prob @ p["out"].T
    carry = np.zeros((2, rows, hidden), np.float32)
    rec_t = np.swapaxes(p["rec"], 1, 2)
    for t in range(width - 1, -1, -1):
        before, z, r, inner, new, live = kept[t]
        back = width - 1 - t
        dh = carry + np.stack([d_top[t, :, :hidden], d_top[back, :, hidden:]])
        if live is not None:
            dh = dh * live
        d_new = dh * (1 - z) * (1 - new * new)
        d_z = dh * (before - new) * z * (1 - z)
        d_r = d_new * inner * r * (1 - r)
        d_x = np.concatenate([d_z, d_r, d_new], axis=2)
        d_a = np.concatenate([d_z, d_r, d_new * r], axis=2)
        g["rec"] += np.swapaxes(before, 1, 2) @ d_a
        g["bias"] += d_a.sum(axis=1, keepdims=True)
        for way, at in ((0, t), (1, back)):
            np.add.at(g["table"][way], windows[:, at], d_x[way])
        carry = dh * z + d_a @ rec_t
    return g


def train(windows: np.ndarray, lengths: np.ndarray, label: np.ndarray, classes: int, hidden: int, steps: int, rows: int, seed: int, rate: float = 0.02) -> dict[str, np.ndarray]:
    p = init(classes, hidden, seed)
    r = np.random.default_rng(seed + 1)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        pick = r.integers(0, len(windows), min(rows, len(windows)))
        g = gradients(p, windows[pick], lengths[pick], label[pick])
        norm = float(np.sqrt(sum(float((v * v).sum()) for v in g.values())))
        scale, now = min(1.0, 1.0 / max(norm, 1e-9)), rate * (1 - step / (steps + 1))
        for k, v in g.items():
            v = v * scale
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            p[k] = (p[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p
