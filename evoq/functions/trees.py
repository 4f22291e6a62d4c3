"""Regression trees in numpy, for the tasks of a forest: one tree from its weighted rows, and predictions of many rows."""

from __future__ import annotations

import numpy as np


def _coarse(x: np.ndarray, bins: int) -> np.ndarray:
    """Columns of more than ``bins`` distinct values, each value lowered to the next of ``bins`` quantiles of them."""
    out = x.copy()
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        if len(values) > bins:
            edges = values[np.arange(bins) * len(values) // bins]
            out[:, f] = edges[np.searchsorted(edges, x[:, f], "right") - 1]
    return out


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, depth: int, bins: int | None = None) -> dict[str, np.ndarray]:
    """A tree of least squares over all features: ``path`` (root 1, children 2i and 2i + 1), ``feature`` (-1: leaf),
    ``threshold`` (at most it: left), ``left``, ``right`` (places in these arrays), ``weight``, ``total`` and ``gain``.

    ``y`` and ``weight`` are whole numbers, so their sums are exact and neither the order of the rows nor a partial sum shows in
    the result. A node is split unless its y are all alike, its x are, or it is ``depth`` below the root; at the middle between
    neighbouring values; of equal gains the first feature and the least value win. All nodes of a level are
    searched at once, feature by feature, along the order of its values.
    """
    if bins:
        x = _coarse(x, bins)
    # By feature the rows still under way, node by node (numbered within the level), each node's by their values.
    inputs, drawn_y = np.ascontiguousarray(x.T), weight * y
    order = [np.argsort(values, kind="stable").astype(np.int32) for values in inputs]
    node, k = np.zeros(len(y), np.int32), 1
    levels = [{"path": np.ones(1, np.int64), "weight": np.array([weight.sum()]), "total": np.array([drawn_y.sum()])}]
    first = 0
    for level in range(depth + 1):
        here, w, s = levels[-1], levels[-1]["weight"], levels[-1]["total"]
        best, of, at = np.full(k, -np.inf), np.full(k, -1, np.int64), np.zeros(k)
        rows = np.flatnonzero(node >= 0)
        low, high = np.full(k, np.inf), np.full(k, -np.inf)
        np.minimum.at(low, node[rows], y[rows])
        np.maximum.at(high, node[rows], y[rows])
        node[rows[(low == high)[node[rows]]]] = -1
        if level < depth and (low < high).any():
            for f in range(x.shape[1]):
                rows = order[f]
                rows = rows[node[rows] >= 0]
                part = node[rows]
                # Numbers of 16 bits are sorted by their digits, in one pass over the rows.
                sort = np.argsort(part.astype(np.uint16) if k <= 65_536 else part, kind="stable")
                order[f] = rows = rows[sort]
                part, values = part[sort], inputs[f][rows]
                same = part[1:] == part[:-1]
                starts = np.flatnonzero(np.concatenate(([True], ~same)))
                cuts = np.flatnonzero(same & (values[1:] > values[:-1]))
                if not len(cuts):
                    continue
                of_cut = part[cuts]
                before_w, before_s = np.zeros(k), np.zeros(k)
                sums_w, sums_s = np.cumsum(weight[rows]), np.cumsum(drawn_y[rows])
                before_w[part[starts[1:]]], before_s[part[starts[1:]]] = sums_w[starts[1:] - 1], sums_s[starts[1:] - 1]
                wl, sl = sums_w[cuts] - before_w[of_cut], sums_s[cuts] - before_s[of_cut]
                rest = s[of_cut] - sl
                gain = sl * sl / wl + rest * rest / (w[of_cut] - wl)
                begins = np.flatnonzero(np.concatenate(([True], of_cut[1:] != of_cut[:-1])))
                nodes, top = of_cut[begins], np.maximum.reduceat(gain, begins)
                hits = np.flatnonzero(gain == np.repeat(top, np.diff(np.append(begins, len(cuts)))))
                places = cuts[hits[np.searchsorted(hits, begins)]]
                better = top > best[nodes]
                nodes, places = nodes[better], places[better]
                middle = (values[places] + values[places + 1]) / 2
                best[nodes], of[nodes], at[nodes] = top[better], f, np.where(middle < values[places + 1], middle, values[places])
        inner = np.flatnonzero(of >= 0)
        child = np.full(k, -1, np.int32)
        child[inner] = 2 * np.arange(len(inner))
        below = np.where(of >= 0, first + k + child, -1)
        here |= {"feature": of, "threshold": at, "left": below, "right": np.where(of >= 0, below + 1, -1),
                 "gain": np.where(of >= 0, best - s * s / w, 0.0)}
        if not len(inner):
            break
        rows = np.flatnonzero(node >= 0)
        part = node[rows]
        go = child[part]
        node[rows] = np.where(go >= 0, go + (inputs[of[part], rows] > at[part]), -1)
        first, k = first + k, 2 * len(inner)
        rows = rows[go >= 0]
        path = 2 * here["path"][inner]
        levels.append({"path": np.stack((path, path + 1), axis=1).ravel(), "weight": np.bincount(node[rows], weight[rows], k),
                       "total": np.bincount(node[rows], drawn_y[rows], k)})
    return {name: np.concatenate([one[name] for one in levels])
            for name in ("path", "feature", "threshold", "left", "right", "weight", "total", "gain")}


def predict_sum(x: np.ndarray, trees: list[tuple], block: int = 4096) -> np.ndarray:
    """Sum over ``(feature, threshold, left, right, value)`` of the trees' values for each row; NaN goes right."""
    out = np.zeros(len(x))
    for feature, threshold, left, right, value in trees:
        for at in range(0, len(x), block):
            part = x[at:at + block]
            rows, node, ends = np.arange(len(part)), np.zeros(len(part), np.int64), np.zeros(len(part))
            while len(rows):
                of = feature[node]
                end = of < 0
                ends[rows[end]] = value[node[end]]
                rows, node, of = rows[~end], node[~end], of[~end]
                node = np.where(part[rows, of] <= threshold[node], left[node], right[node])
            out[at:at + block] += ends
    return out


def predict_swapped_sum(x: np.ndarray, z: np.ndarray, trees: list[tuple], block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the trees for each row as it is, and, by feature, for the row with that one feature taken from the row of ``z``.

    A row with a swapped feature goes the way of the row itself up to the first node on that feature that parts the two values; only
    from there on it is walked by itself, so a tree costs what its ways differ by, not a walk per feature.
    """
    own, swapped = np.zeros(len(x)), np.zeros(x.shape)
    for feature, threshold, left, right, value in trees:
        for at in range(0, len(x), block):
            a, b = x[at:at + block], z[at:at + block]
            base, moved, parted = np.zeros(len(a)), np.zeros(a.shape), np.zeros(a.shape, bool)
            rows, node = np.arange(len(a)), np.zeros(len(a), np.int64)
            # Swapped rows under way: row, feature that was swapped, node.
            far, by, there = (np.zeros(0, np.int64) for _ in range(3))
            while len(rows) or len(far):
                of = feature[there]
                end = of < 0
                moved[far[end], by[end]] = value[there[end]]
                far, by, there, of = far[~end], by[~end], there[~end], of[~end]
                low = np.where(of == by, b[far, of], a[far, of]) <= threshold[there]
                there = np.where(low, left[there], right[there])
                of = feature[node]
                end = of < 0
                base[rows[end]] = value[node[end]]
                rows, node, of = rows[~end], node[~end], of[~end]
                low, other = a[rows, of] <= threshold[node], b[rows, of] <= threshold[node]
                fresh = (low != other) & ~parted[rows, of]
                parted[rows[fresh], of[fresh]] = True
                far, by = np.concatenate((far, rows[fresh])), np.concatenate((by, of[fresh]))
                there = np.concatenate((there, np.where(other, left[node], right[node])[fresh]))
                node = np.where(low, left[node], right[node])
            own[at:at + block] += base
            swapped[at:at + block] += np.where(parted, moved, base[:, None])
    return own, swapped
