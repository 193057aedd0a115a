"""Trees of a random forest, each grown whole in one task from rows cut into bins.

All nodes of a level are split at once: a histogram of weights and targets per node and bin gives the gain of every split.
A numeric feature is split between two bins, a text feature into one value and the rest. Rows of the test part go down
with the training rows, so a task hands back their predictions and the gains of features, and no model travels.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

CELLS = 1 << 21  # cells of a histogram that are held at a time
# Chances of drawing a row at most 0, 1, 2, ... times: a Poisson distribution with mean 1.
DRAWN = np.cumsum([np.exp(-1.0) / f for f in np.cumprod([1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10], dtype=float)])


@dataclass(frozen=True)
class Plan:
    """What is the same for all trees: features (bins and whether a bin is split off alone), classes, sizes."""

    bins: tuple[int, ...]
    alone: tuple[bool, ...]
    classes: int  # 0: regression
    depth: int
    seed: int
    some: int | None  # columns looked at in a split; None: all

    def columns(self) -> list[int]:
        """The first column of each feature: a numeric feature is one, a text feature one for each value but the first."""
        return np.concatenate([[0], np.cumsum([b - 1 if a else 1 for b, a in zip(self.bins, self.alone)])]).tolist()


def _scrambled(values: np.ndarray, salt: int) -> np.ndarray:
    x = values.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def times_drawn(draw: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree's sample with replacement holds each row, by the row's own random number."""
    share = (_scrambled(_scrambled(draw, seed), tree + 1) >> np.uint64(11)).astype(float) / float(1 << 53)
    return np.searchsorted(DRAWN, share, side="right").astype(float)


def part_bits(rows: int) -> int:
    """Bits of a part of a target, see ``exact_parts``; a row is drawn no oftener than there are chances."""
    return max(1, 51 - math.ceil(math.log2(max(2, rows) * (len(DRAWN) + 1))))


def exact_parts(y: np.ndarray, largest: float, rows: int) -> list[np.ndarray]:
    """Targets as sums of parts of few bits, whose weighted sums over all rows are exact, hence the same in any order."""
    bits = part_bits(rows)
    out, rest = [], y
    for i in range(1, -(-54 // bits) + 1):
        exponent = math.frexp(largest)[1] - i * bits if 0 < largest < np.inf else -2000
        part = np.round(np.ldexp(rest, -exponent)) if exponent > -1000 else None
        part = rest if part is None else np.ldexp(part, exponent)
        out.append(part)
        rest = rest - part
    return out


def add_to(total: tuple[np.ndarray, np.ndarray] | None, cells: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Add the sums of ascending cells to those of others."""
    if total is None or not len(total[0]):
        return cells, sums
    at = np.minimum(np.searchsorted(total[0], cells), len(total[0]) - 1)
    known = total[0][at] == cells
    total[1][at[known]] += sums[known]
    if known.all():
        return total
    return merged(np.concatenate([total[0], cells[~known]]), np.concatenate([total[1], sums[~known]]))


def merged(cells: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells once each, ascending, and the sums (cell, ...) of equal ones."""
    order = np.argsort(cells, kind="stable")
    cells = cells[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(cells)), bool), cells[1:] != cells[:-1]]))
    return cells[first], np.add.reduceat(sums[order], first, axis=0) if len(first) else sums[:0]


def _sums(cell: np.ndarray, cells: int, y: np.ndarray, w: np.ndarray, wy: np.ndarray, classes: int) -> np.ndarray:
    """Per cell: weight and weighted target, or the weight of each class."""
    if classes:
        return np.bincount(cell * classes + y, w, cells * classes).reshape(cells, classes)
    return np.stack([np.bincount(cell, w, cells), np.bincount(cell, wy, cells)], axis=-1)


def _worth(sums: np.ndarray, classes: int) -> np.ndarray:
    """What a split makes larger: squared sums over weight. Its gain is the decrease of variance or of Gini impurity, times the weight."""
    weight = sums.sum(axis=-1) if classes else sums[..., 0]
    squares = (sums**2).sum(axis=-1) if classes else sums[..., 1] ** 2
    return np.divide(squares, weight, out=np.zeros_like(weight), where=weight > 0)


def _weight(sums: np.ndarray, classes: int) -> np.ndarray:
    return sums.sum(axis=-1) if classes else sums[..., 0]


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, plan: Plan, seed: list[int], depth: int, wy: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Grow one tree over rows of bins; rows of weight 0 only go down. Returns the leaf of each row, the gain of each column, and the levels.

    A row may stand for many of equal bins: ``wy`` is then the sum of their weighted targets.
    """
    columns = [np.ascontiguousarray(x[:, f]) for f in range(len(plan.bins))]
    y, wy = y.astype(np.int64) if plan.classes else y, w * y if wy is None else wy
    # rows that are still going down, and the node of each: those with a weight, which decide, and the others
    groups = [[rows, np.zeros(len(rows), np.int64)] for rows in (np.flatnonzero(w > 0), np.flatnonzero(w <= 0))]
    leaf = np.zeros(len(y), np.int64)
    firsts = plan.columns()
    gains = np.zeros(firsts[-1])
    leaves, nodes = 1, 1
    rng = np.random.default_rng(seed)
    room = max(1, CELLS // (max(plan.bins, default=1) * max(plan.classes, 2)))
    alone = np.array(plan.alone)
    for level in range(depth):
        rows, node = groups[0]
        if nodes > room:  # nodes are worked on in blocks of rows that lie together
            order = np.argsort(node, kind="stable")
            rows, node = groups[0] = [rows[order], node[order]]
        best, feature, place = np.full(nodes, -1.0), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        for low in range(0, nodes, room):
            high = min(nodes, low + room)
            a, b = (0, len(rows)) if nodes <= room else np.searchsorted(node, [low, high])
            own, near, held = rows[a:b], node[a:b] - low, high - low
            own_y, own_w, own_wy = y[own], w[own], wy[own]
            allowed = None
            if plan.some is not None and plan.some < firsts[-1]:
                allowed = np.argsort(np.argsort(rng.random((held, firsts[-1])), axis=1), axis=1) < plan.some
            for f, width in enumerate(plan.bins):
                if width < 2:
                    continue
                sums = _sums(near * width + columns[f][own], held * width, own_y, own_w, own_wy, plan.classes).reshape(held, width, -1)
                total = sums.sum(axis=1, keepdims=True)
                left = sums[:, 1:] if plan.alone[f] else np.cumsum(sums, axis=1)[:, :-1]
                right = total - left
                gain = _worth(left, plan.classes) + _worth(right, plan.classes) - _worth(total, plan.classes)
                gain[(_weight(left, plan.classes) < 0.5) | (_weight(right, plan.classes) < 0.5)] = -1.0
                if allowed is not None:
                    gain[~allowed[:, firsts[f] : firsts[f + 1]] if plan.alone[f] else ~allowed[:, firsts[f]]] = -1.0
                at = gain.argmax(axis=1)
                top = gain[np.arange(held), at]
                better = np.flatnonzero(top > best[low:high])
                best[low + better], feature[low + better], place[low + better] = top[better], f, at[better] + plan.alone[f]
        splits = best > 1e-9
        number = np.cumsum(splits) - 1  # of those that are split, and of the new leaves
        ended = leaves + np.arange(nodes) - number - 1
        leaves += int(nodes - splits.sum())
        for f in range(len(plan.bins)):
            of = splits & (feature == f)
            np.add.at(gains, firsts[f] + (place[of] - 1 if plan.alone[f] else np.zeros(int(of.sum()), np.int64)), best[of])
        for group in groups:
            rows, node = group
            stays = splits[node]
            leaf[rows[~stays]] = ended[node[~stays]]
            rows, node = rows[stays], node[stays]
            right = np.zeros(len(rows), bool)
            for f in range(len(plan.bins)):
                of = np.flatnonzero(feature[node] == f)
                value, cut = columns[f][rows[of]], place[node[of]]
                right[of] = value == cut if alone[f] else value > cut
            group[:] = rows, 2 * number[node] + right
        nodes = 2 * int(splits.sum())
        if not nodes:
            return leaf, gains, level
    for rows, node in groups:
        leaf[rows] = leaves + node
    return leaf, gains, depth


def values_of(leaf: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, wy: np.ndarray | None = None) -> np.ndarray:
    """Per leaf: the mean target, or the share of each class; leaves without weight take the mean of all."""
    sums = _sums(leaf, int(leaf.max(initial=0)) + 1, y.astype(np.int64) if classes else y, w, w * y if wy is None else wy, classes)
    weight = _weight(sums, classes)
    own = sums if classes else sums[:, 1:]
    every = own.sum(axis=0) / max(weight.sum(), 1e-300)
    return np.where(weight[:, None] > 0, own / np.maximum(weight, 1e-300)[:, None], every)
