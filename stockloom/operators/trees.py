"""Regression trees on binned features: what a task grows, predicts and explains.

A tree is rows of numbers by node: the feature that parts it, the last bin that
goes left, the left child (the right one follows it; 0 at a leaf), value and
cover. Spark deals the trees and the rows out; nothing here knows of it.
"""

from __future__ import annotations

from collections.abc import Generator, Iterable, Iterator

import numpy as np

#: Bins of a feature, rows that walk a tree at once, and nodes of a level whose sums are kept for the next.
BINS, BLOCK, KEPT = 48, 16_384, 1024
NODE = (("feature", np.int16), ("cut", np.int16), ("left", np.int32), ("value", np.float64), ("cover", np.float64))
Tree = dict[str, np.ndarray]


def edges_of(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Of each column the values after which its bins end, by quantiles."""
    return [np.unique(np.quantile(column, np.arange(1, bins) / bins)) for column in x.T]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, column) for e, column in zip(edges, x.T, strict=True)], axis=1).astype(np.int16) if len(edges) else np.zeros((len(x), 0), np.int16)


def _best(features: np.ndarray, sums: Iterable, w: np.ndarray, s: np.ndarray, least: float, ridge: float) -> tuple[np.ndarray, ...]:
    """Of each node the split of greatest gain: gain, feature, cut, and weight and sum of what goes left; ``sums`` has weights and sums by node and bin of each feature."""
    n = len(w)
    gain, part, cut, lighter, lower = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    for f, (lw, ls) in zip(features, sums, strict=True):
        lw, ls = np.cumsum(lw, axis=1), np.cumsum(ls, axis=1)
        rw, rs = w[:, None] - lw, s[:, None] - ls
        found = ls * ls / (lw + ridge + 1e-12) + rs * rs / (rw + ridge + 1e-12)
        found[(lw < least) | (rw < least) | (lw <= 0) | (rw <= 1e-9)] = -np.inf
        at = found.argmax(axis=1)
        best = found[np.arange(n), at]
        better = best > gain
        gain[better], part[better], cut[better] = best[better], f, at[better]
        lighter[better], lower[better] = lw[better, at[better]], ls[better, at[better]]
    return gain, part, cut, lighter, lower


def _split(flat: Tree, ids: np.ndarray, splits: np.ndarray, part: np.ndarray, cut: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The nodes with the children of those that split, and the children's places."""
    made, n = len(flat["left"]), int(splits.sum())
    flat = {name: np.concatenate([v, np.full(2 * n, -1.0 if name == "feature" else 0.0)]) for name, v in flat.items()}
    flat["feature"][ids[splits]], flat["cut"][ids[splits]], flat["left"][ids[splits]] = part[splits], cut[splits], made + 2 * np.arange(n)
    return flat, made + np.arange(2 * n)


def _lighter(ids: np.ndarray, w: np.ndarray, parents: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which nodes' rows are summed, and of the others their sibling's and their parent's place: what a parent has and its lighter child hasn't lies in the heavier one."""
    at, direct, sibling, parent = {int(k): j for j, k in enumerate(ids)}, np.ones(len(ids), bool), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    for j, k in enumerate(ids.tolist()):
        # children lie side by side, the left one at an odd place
        other = at.get(k + 1 if k % 2 else k - 1)
        if k in parents and other is not None and (w[j], -j) > (w[other], -other):
            direct[j], sibling[j], parent[j] = False, other, parents[k]
    return direct, sibling[~direct], parent[~direct]


def _root() -> Tree:
    return {name: np.full(1, -1.0 if name == "feature" else 0.0) for name, _ in NODE}


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, features: np.ndarray, depth: int, least: float, ridge: float) -> Tree:
    """The tree that splits level by level where squared error falls most; a child has weight ``least`` at least, a value is shrunk by ``ridge``.

    Rows of nodes that cannot be split, as they weigh too little or hold no
    error that a split could take away, are left out of the level's sums.
    """
    keep = weight > 0
    columns, weight = np.ascontiguousarray(x[keep].T), weight[keep].astype(float)
    wy = weight * y[keep]
    wyy = wy * y[keep]
    widths = columns.max(axis=1, initial=0).astype(np.int64) + 1
    node, level, ids, flat = np.zeros(len(weight), np.int64), 0, np.zeros(1, np.int64), _root()
    kept, parents = [], {}
    while True:
        n = len(ids)
        w, s = np.bincount(node, weight, n), np.bincount(node, wy, n)
        flat["cover"][ids], flat["value"][ids] = w, s / np.maximum(w + ridge, 1e-12)
        if level == depth or not len(features):
            break
        held = s * s / (w + ridge + 1e-12)
        able = (w >= 2 * least) & (np.bincount(node, wyy, n) - held > 5e-10)
        if not able.any():
            break
        if not able.all():
            stay = able[node]
            columns, weight, wy, wyy, node = columns[:, stay], weight[stay], wy[stay], wyy[stay], (np.cumsum(able) - 1)[node[stay]]
            ids, w, s, held, n = ids[able], w[able], s[able], held[able], int(able.sum())
        direct, sibling, parent = _lighter(ids, w, parents)
        some = slice(None) if direct.all() else np.flatnonzero(direct[node])
        place, wd, wyd, before, kept = (np.cumsum(direct) - 1)[node[some]], weight[some], wy[some], kept, []

        def sums() -> Iterator[np.ndarray]:
            for k, f in enumerate(features):
                width = int(widths[f])
                key, found = place * width + columns[f][some], np.empty((2, n, width))
                found[:, direct] = [np.bincount(key, v, int(direct.sum()) * width).reshape(-1, width) for v in (wd, wyd)]
                if len(parent):
                    found[:, ~direct] = before[k][:, parent] - found[:, sibling]
                if n <= KEPT:
                    kept.append(found)
                yield found

        gain, part, cut, _, _ = _best(features, sums(), w, s, least, ridge)
        splits = gain > held + 1e-9
        if not splits.any():
            break
        flat, ids = _split(flat, ids, splits, part, cut)
        parents = dict(zip(ids.tolist(), np.repeat(np.flatnonzero(splits), 2).tolist(), strict=True)) if kept else {}
        if not splits.all():
            stay = splits[node]
            columns, weight, wy, wyy, node = columns[:, stay], weight[stay], wy[stay], wyy[stay], node[stay]
        right = columns[part[node], np.arange(len(node))] > cut[node]
        node = 2 * (np.cumsum(splits) - 1)[node] + right
        level += 1
    return {name: flat[name].astype(kind) for name, kind in NODE}


def planned(features: np.ndarray, depth: int, least: float, ridge: float, most: float = 0.0) -> Generator[tuple[Tree, np.ndarray], np.ndarray, tuple[Tree, dict[int, int]]]:
    """A tree as ``grow`` makes it, of rows that lie elsewhere: gives the tree so far and nodes to split, and is sent what ``sums`` has of them, added up over all rows.

    At the end it has the tree, and of each node that weighs ``most`` or less
    and could be split the depth that it may still take.
    """
    ids, level, flat, left, known, parents = np.zeros(1, np.int64), 0, _root(), {}, None, {}
    direct = np.ones(1, bool)
    while True:
        if known is not None:
            w, s = known
            flat["cover"][ids], flat["value"][ids] = w, s / np.maximum(w + ridge, 1e-12)
            able = (w >= 2 * least) & (level < depth)
            small = able & (w <= most)
            left |= {int(k): depth - level for k in ids[small]}
            able &= ~small
            if not able.any():
                break
            ids, w, s = ids[able], w[able], s[able]
            direct, sibling, parent = _lighter(ids, w, parents)
        given = yield flat, ids[direct]
        if known is None:
            found = given
            w, s = found[0].sum(axis=2)
            flat["cover"][0], flat["value"][0] = w[0], s[0] / max(w[0] + ridge, 1e-12)
        else:
            before, found = found, np.empty((len(features), 2, len(ids), BINS))
            found[:, :, direct] = given
            found[:, :, ~direct] = before[:, :, parent] - found[:, :, sibling]
        held = s * s / (w + ridge + 1e-12)
        gain, part, cut, lighter, lower = _best(features, found, w, s, least, ridge)
        splits = gain > held * (1 + 1e-12) + 1e-9  # sums of many rows are rounded
        if not splits.any():
            break
        flat, ids = _split(flat, ids, splits, part, cut)
        parents = dict(zip(ids.tolist(), np.repeat(np.flatnonzero(splits), 2).tolist(), strict=True))
        known = [np.stack([a, b - a], axis=1)[splits].ravel() for a, b in ((lighter, w), (lower, s))]
        level += 1
    return {name: flat[name].astype(kind) for name, kind in NODE}, left


def sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, tree: Tree, ids: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Weights and weighted targets of rows by feature, node of ``ids`` and bin; ``x`` has a line a feature."""
    place = np.full(len(tree["left"]), -1)
    place[ids] = np.arange(len(ids))
    node = place[places(tree, x)]
    rows = np.flatnonzero((node >= 0) & (weight > 0))
    start, w = node[rows] * BINS, weight[rows].astype(float)
    wy, size = w * y[rows], len(ids) * BINS
    return np.array([[np.bincount(key, v, size).reshape(-1, BINS) for v in (w, wy)] for f in features for key in (start + x[f][rows],)])


def depth_of(tree: Tree) -> int:
    """How many splits the longest path has."""
    found, level = 0, tree["left"][:1]
    while (level := level[level > 0]).size:
        found, level = found + 1, tree["left"][np.concatenate([level, level + 1])]
    return found


def routed(tree: Tree) -> tuple:
    """A tree as ``summed`` walks it: a leaf leads to itself, as no bin lies beyond its cut; and as many steps as its longest path has."""
    leaf = tree["left"] == 0
    return (
        np.where(leaf, 0, tree["feature"]).astype(np.intp), np.where(leaf, np.iinfo(np.int16).max, tree["cut"]).astype(np.int16),
        np.where(leaf, np.arange(len(leaf)), tree["left"]).astype(np.intp), tree["value"], depth_of(tree),
    )


def _walk(flat: np.ndarray, at: np.ndarray, route: tuple) -> np.ndarray:
    """The leaf of each row; ``flat`` has all rows' first features, then all second ones, and so on."""
    feature, cut, left, _, steps = route
    column, node = feature * len(at), np.zeros(len(at), np.intp)
    for _ in range(steps):
        cell = column.take(node)
        cell += at
        right = flat.take(cell) > cut.take(node)
        node = left.take(node)
        node += right
    return node


def summed(routes: list[tuple], x: np.ndarray) -> np.ndarray:
    """Sum of the trees' values of binned rows, tree by tree on blocks of rows that stay in a processor's cache."""
    out = np.zeros(len(x))
    for begin in range(0, len(x), BLOCK):
        part, own = x[begin : begin + BLOCK], out[begin : begin + BLOCK]
        flat, at = np.ascontiguousarray(part.T).ravel(), np.arange(len(part))
        for route in routes:
            own += route[3].take(_walk(flat, at, route))
    return out


def places(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each binned row of a tree that may still be growing; ``x`` has a line a feature."""
    tree = {name: tree[name].astype(kind) for name, kind in NODE}
    return _walk(np.ascontiguousarray(x).ravel(), np.arange(x.shape[1]), routed(tree))


def predict(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Values of binned rows."""
    return summed([routed(tree)], x)


def boost(x: np.ndarray, y: np.ndarray, p: dict, seed: int):
    """Trees one after another, each on what those before have left; values are scaled by the rate. The first is the mean."""
    r = np.random.default_rng(seed)
    held = np.full(len(y), y.mean())
    yield {name: np.array([{"feature": -1, "value": y.mean(), "cover": len(y)}.get(name, 0)]).astype(kind) for name, kind in NODE}
    some = max(1, round(p["columns"] * x.shape[1]))
    for _ in range(p["trees"]):
        weight = (r.random(len(y)) < p["rows"]).astype(float)
        if not weight.any():
            continue
        tree = grow(x, y - held, weight, r.choice(x.shape[1], some, replace=False), p["depth"], p["least"], p["ridge"])
        tree["value"] = tree["value"] * p["rate"]
        held = held + predict(tree, x)
        yield tree


def drawn(sizes: np.ndarray, block: int, seed: int) -> np.ndarray:
    """How often each row of a block is drawn when as many rows are drawn with replacement as all blocks have."""
    n, size = int(sizes.sum()), int(sizes[block])
    counts = np.random.default_rng(seed).multinomial(n, sizes / max(n, 1))
    return np.bincount(np.random.default_rng([seed, block]).integers(0, max(size, 1), counts[block]), minlength=size)


def bag(x: np.ndarray, y: np.ndarray, p: dict, seed: int) -> Tree:
    """One tree of a forest, on rows drawn with replacement; its values are divided by the number of trees."""
    r = np.random.default_rng(seed)
    weight = np.bincount(r.integers(0, len(y), len(y)), minlength=len(y))
    tree = grow(x, y, weight, np.arange(x.shape[1]), p["depth"], p["least"], 0.0)
    tree["value"] = tree["value"] / p["trees"]
    return tree


def _paths(tree: Tree) -> list[tuple[int, dict[int, tuple[int, int, float]]]]:
    """Of each leaf its value's node and, by feature of its path, the bins it lets through (above, up to) and the share of rows that go on there."""
    out, stack = [], [(0, {})]
    while stack:
        node, path = stack.pop()
        left = int(tree["left"][node])
        if not left:
            out.append((node, path))
            continue
        f, cut = int(tree["feature"][node]), int(tree["cut"][node])
        above, upto, share = path.get(f, (-1, 1 << 14, 1.0))
        for child, bounds in ((left, (above, min(upto, cut))), (left + 1, (max(above, cut), upto))):
            stack.append((child, path | {f: (*bounds, share * tree["cover"][child] / tree["cover"][node])}))
    return out


def shapley(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Exact Shapley values of binned rows under the tree's own path-dependent expectation; a row's sum is its prediction less the tree's mean.

    A leaf is reached with 1 or 0 by features that are known, and by the share
    of rows that go on there by those that are not. The sum over all orders is
    that over sizes of known sets, whose products are a polynomial's
    coefficients: those of all other features are built up from the front and
    from the back.
    """
    out = np.zeros(x.shape)
    for leaf, path in _paths(tree):
        names = list(path)
        d = len(names)
        if not d:
            continue
        ones = np.stack([(x[:, f] > path[f][0]) & (x[:, f] <= path[f][1]) for f in names]).astype(float)
        zeros = np.array([path[f][2] for f in names])
        sizes = [1.0 / d]
        for k in range(1, d):
            sizes.append(sizes[-1] * k / (d - k))  # k! (d - k - 1)! / d!
        sizes = np.array(sizes)
        front = [np.ones((1, len(x)))]
        for k in range(d - 1):
            front.append(_times(front[-1], zeros[k], ones[k]))
        back = np.ones((1, len(x)))
        for k in range(d - 1, -1, -1):
            others = np.zeros((d, len(x)))
            for a in range(front[k].shape[0]):
                others[a : a + back.shape[0]] += front[k][a] * back
            out[:, names[k]] += tree["value"][leaf] * (ones[k] - zeros[k]) * (sizes @ others)
            back = _times(back, zeros[k], ones[k])
    return out


def _times(poly: np.ndarray, zero: float, one: np.ndarray) -> np.ndarray:
    """A polynomial, by row, times zero + one t."""
    out = np.zeros((len(poly) + 1, poly.shape[1]))
    out[:-1] += poly * zero
    out[1:] += poly * one
    return out


def mean(tree: Tree) -> float:
    """The tree's expectation where nothing is known."""
    leaves = tree["left"] == 0
    return float((tree["value"] * tree["cover"])[leaves].sum() / tree["cover"][leaves].sum())
