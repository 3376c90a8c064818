"""A convolutional text classifier over hashed word embeddings, in numpy.

A word's embedding is the sum of the rows of its whole form and of its
prefixes, so that inflected forms of one stem share most of it.
Several filter widths slide over a text's word embeddings; each filter's
largest response over the text goes to a logistic output. Only the position of
that largest response gets a gradient, so training touches few rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Forms (the word and its prefixes) share a row where their hashes agree modulo BUCKETS.
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 17, 8, (1, 2, 3), 6


@dataclass
class Net:
    table: np.ndarray  # [BUCKETS, DIM]
    taps: np.ndarray  # [DIM, sum(WIDTHS) * FILTERS], filters of one width and place beside each other
    bias: np.ndarray  # [len(WIDTHS) * FILTERS]
    out: np.ndarray
    out_bias: float


def init(seed: int, signals: list[np.ndarray]) -> Net:
    """``signals`` (for each form one number a bucket) are the first coordinates of the embeddings."""
    r = np.random.default_rng(seed)
    f = np.float32
    table = (r.standard_normal((BUCKETS, DIM)) * 0.05).astype(f)
    for k, signal in enumerate(signals):
        table[:, k] = signal
    taps = (r.standard_normal((DIM, sum(WIDTHS) * FILTERS)) * 0.3).astype(f)
    at = 0
    for w in WIDTHS:
        k = len(signals)
        taps[:k, at : at + FILTERS] = np.abs(taps[:k, at : at + FILTERS]) + 0.3
        at += w * FILTERS
    return Net(table, taps, np.zeros(len(WIDTHS) * FILTERS, f), np.full(len(WIDTHS) * FILTERS, 0.3, f), -1.0)


def embedded(net: Net, ids: np.ndarray) -> np.ndarray:
    """Embeddings of words given by [words, forms] buckets."""
    out = net.table[ids[:, 0]]
    for k in range(1, ids.shape[1]):
        out += net.table[ids[:, k]]
    return out


def responses(net: Net, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Every filter's response at every word; beyond a text's end lie zero vectors."""
    parts = embedded(net, ids) @ net.taps
    n = len(ids)
    last = np.zeros(n + 1, bool)
    last[first] = True  # where a text begins, and the end
    out, at = [], 0
    for w in WIDTHS:
        sums = parts[:, at : at + FILTERS].copy()
        inside = np.ones(n, bool)
        for k in range(1, w):
            # word i + k must belong to the text of word i
            inside[: n - k] &= ~last[k:n] if k < n else True
            inside[max(0, n - k) :] = False
            shifted = parts[k:, at + k * FILTERS : at + (k + 1) * FILTERS]
            sums[: n - k] += shifted * inside[: n - k, None]
        out.append(sums)
        at += w * FILTERS
    return np.concatenate(out, axis=1)


def pooled(net: Net, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Largest responses [texts, filters]; a text without words has 0."""
    texts = len(first) - 1
    out = np.zeros((texts, len(net.bias)), np.float32)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.maximum.reduceat(responses(net, ids, first), first[:-1][some], axis=0)
    return np.maximum(out + net.bias, 0)


def probability(net: Net, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(pooled(net, ids, first) @ net.out + net.out_bias)))


def train(net: Net, ids: list[np.ndarray], label: np.ndarray, weight: np.ndarray, epochs: int, rows: int, seed: int, rate: float = 0.05, decay: float = 1e-3) -> Net:
    """Adagrad on weighted cross entropy; ``ids`` has the buckets of each text's words."""
    r = np.random.default_rng(seed)
    seen_table = np.full(BUCKETS, 1.0, np.float32)
    seen = [np.full(x.shape, 1.0, np.float32) for x in (net.taps, net.bias, net.out)]
    seen_b = 1.0
    for _ in range(epochs):
        order = r.permutation(len(ids))
        for k in range(0, len(order), rows):
            pick = order[k : k + rows]
            flat = np.concatenate([ids[i] for i in pick])
            first = np.concatenate([[0], np.cumsum([len(ids[i]) for i in pick])])
            if not len(flat):
                continue
            resp = responses(net, flat, first)
            where = np.zeros((len(pick), resp.shape[1]), np.int64)
            top = np.zeros((len(pick), resp.shape[1]), np.float32)
            for i in range(len(pick)):
                part = resp[first[i] : first[i + 1]]
                if len(part):
                    where[i] = part.argmax(axis=0) + first[i]
                    top[i] = part.max(axis=0)
            held = np.maximum(top + net.bias, 0)
            prob = 1 / (1 + np.exp(-(held @ net.out + net.out_bias)))
            err = ((prob - label[pick]) * weight[pick] / len(pick)).astype(np.float32)
            g_out = held.T @ err + decay * net.out
            g_held = err[:, None] * net.out * (held > 0)
            g_bias = g_held.sum(axis=0)
            g_taps = np.zeros_like(net.taps)
            stops = first[1:]
            at = 0
            for j, w in enumerate(WIDTHS):
                cols = slice(j * FILTERS, (j + 1) * FILTERS)
                for tap in range(w):
                    word = where[:, cols] + tap
                    ok = (word < stops[:, None]) & (np.diff(first) > 0)[:, None]
                    bucket = flat[np.minimum(word, len(flat) - 1)]  # [texts, FILTERS, forms]
                    g = g_held[:, cols] * ok
                    here = slice(at + tap * FILTERS, at + (tap + 1) * FILTERS)
                    vectors = net.table[bucket].sum(axis=2)
                    g_taps[:, here] += np.einsum("tf,tfd->df", g, vectors)
                    g_word = g[:, :, None] * net.taps[:, here].T
                    hit, inverse = np.unique(bucket[ok], return_inverse=True)
                    total = np.zeros((len(hit), DIM), np.float32)
                    np.add.at(total, inverse.reshape(-1), np.repeat(g_word[ok], flat.shape[1], axis=0))
                    seen_table[hit] += (total * total).sum(axis=1)
                    net.table[hit] -= rate * total / np.sqrt(seen_table[hit])[:, None]
                at += w * FILTERS
            g_taps += decay * net.taps
            for value, g, s in zip((net.taps, net.bias, net.out), (g_taps, g_bias, g_out), seen, strict=True):
                s += g * g * 100
                value -= rate * 10 * g / np.sqrt(s)
            g_b = float(err.sum())
            seen_b += g_b * g_b * 100
            net.out_bias -= rate * 10 * g_b / seen_b**0.5
    return net
