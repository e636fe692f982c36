"""Growing decision trees from binned rows: what one block of rows adds to the sums, and what the sums decide.

Rows are cut to small whole numbers once (``Bins``). A tree needs, per node, feature and bin, the sums of gradient, Hessian and rows;
``node_sums`` adds them up for a block, and ``Growth`` picks the splits from the total over all blocks. Gradients are rounded to
multiples of 2^-20, so sums are exact and a tree is the same however the rows are dealt to blocks.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from functools import cached_property
from typing import Any

import numpy as np
import pyarrow as pa

MAX_BINS = 64  # bins of one feature
SCALE = float(1 << 20)  # gradients and Hessians are multiples of 1 / SCALE
_LEAST_GAIN = 1e-9
_STRIDE = 256  # a bin is one byte
_TOGETHER = 16  # nodes whose splits are searched at a time
_CELLS = 4608  # combinations of bins that features counted together have, at most
_DENSE = 600  # rows a node from which features are counted together


@dataclass(frozen=True)
class TreePlan:
    """Everything that decides an ensemble of trees, apart from its rows.

    ``criterion``: ``newton`` (gradient and Hessian), ``residual`` (gradient and rows; leaves are Newton steps), ``gini`` or ``entropy``.
    ``grow``: ``level``, ``best`` (best gain first, up to ``leaves``) or ``oblivious`` (one split for a whole level).
    ``bootstrap``: ``none``, ``share`` (each row with probability ``row_share``), ``poisson``, ``bayesian`` or ``mvs``.
    ``weights``: ``none``, ``balanced``, ``subsample`` (balanced in each tree's own sample) or the weight of class 1 as text.
    """

    boosted: bool = True
    rounds: int = 100
    rate: float = 0.1
    depth: int | None = 3
    leaves: int | None = None
    grow: str = "level"
    criterion: str = "newton"
    l1: float = 0.0
    l2: float = 0.0
    min_gain: float = 0.0
    min_rows: int = 1
    min_hessian: float = 0.0
    min_split: int = 2
    bootstrap: str = "none"
    row_share: float = 1.0
    temperature: float = 1.0
    feature_share: float = 1.0
    node_features: str = "all"
    weights: str = "none"
    prior: bool = False
    seed: int = 42

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)


def sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -500.0, 500.0)))


# --- rows ---------------------------------------------------------------------------------------


@dataclass
class Bins:
    """Cut points per feature; value x lies in bin i if exactly i cut points are below it. NaN lies in the last bin."""

    edges: list[list[float]]

    def __post_init__(self) -> None:
        self.sizes = np.array([len(e) + 1 for e in self.edges], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.total = int(self.sizes.sum())
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.groups = self._groups()

    def _groups(self) -> list[list[int]]:
        """Features that are counted together: a row adds to one cell of their combined bins, and the cells add up to each one's bins."""
        out: list[list[int]] = []
        cells: list[int] = []
        for j in np.argsort(-self.sizes, kind="stable").tolist():
            size = int(self.sizes[j])
            at = next((i for i, c in enumerate(cells) if c * size <= _CELLS), len(out))
            if at == len(out):
                out.append([])
                cells.append(1)
            out[at].append(j)
            cells[at] *= size
        return out

    def codes(self, columns: np.ndarray) -> np.ndarray:
        """(groups, rows): the cell of each row in each group of features."""
        out = np.zeros((len(self.groups), columns.shape[1]), dtype=np.uint16)
        for row, group in zip(out, self.groups, strict=True):
            for j in group:
                row *= np.uint16(self.sizes[j])
                row += columns[j]
        return out

    def cut(self, x: np.ndarray) -> np.ndarray:
        """Bins of a matrix of values, one byte each."""
        out = np.empty(x.shape, dtype=np.uint8)
        for j, edges in enumerate(self.edges):
            out[:, j] = np.searchsorted(np.asarray(edges), x[:, j], side="left")
        return out


@dataclass
class Block:
    """Some rows: their bins, labels, folds and marks (a number per row that decides its random draws)."""

    bins: np.ndarray
    label: np.ndarray
    fold: np.ndarray
    mark: np.ndarray
    key: pa.Array | None = None

    @cached_property
    def columns(self) -> np.ndarray:
        """The bins feature by feature."""
        return np.ascontiguousarray(self.bins.T)

    @cached_property
    def by_row(self) -> np.ndarray:
        """The bins row after row in one array."""
        return np.ascontiguousarray(self.bins).ravel()

    def codes(self, bins: Bins) -> np.ndarray:
        """The cells of ``Bins.codes``, worked out once."""
        if "_codes" not in self.__dict__:
            self._codes = bins.codes(self.columns)
        return self._codes

    def take(self, rows: np.ndarray) -> Block:
        key = None if self.key is None else self.key.take(pa.array(rows))
        bins = self.bins.T.take(rows, axis=1).T if self.bins.flags.f_contiguous else self.bins[rows]
        return Block(bins, self.label[rows], self.fold[rows], self.mark[rows], key)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit mixing generator: neighbouring numbers come out unrelated."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _uniform(mark: np.ndarray, *salt: int) -> np.ndarray:
    """A number in (0, 1) per mark."""
    key = np.uint64(0)
    for s in salt:
        key = _mix(np.array([s], dtype=np.uint64) ^ key)[0]
    return ((_mix(mark.astype(np.uint64) ^ key) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def gradients(
    block: Block, margin: np.ndarray | None, plan: TreePlan, tree: int, classes: tuple[float, float], cut: float | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows in the sample, gradient, Hessian, row counts) of tree number ``tree``; ``cut`` is the threshold of the mvs bootstrap.

    For forests the gradient is the number of drawn rows of class 1 and the Hessian the number of drawn rows.
    """
    y = block.label
    drawn = np.ones(len(y))
    if plan.bootstrap == "poisson":
        u, term, total = _uniform(block.mark, plan.seed, tree), np.full(len(y), np.exp(-1.0)), np.zeros(len(y))
        drawn = np.zeros(len(y))
        for k in range(1, 12):  # inverse of the distribution with mean 1
            total = total + term
            drawn += u > total
            term = term / k
    elif plan.bootstrap in ("share", "mvs") and plan.row_share < 1 and cut is None:
        drawn = (_uniform(block.mark, plan.seed, tree) < plan.row_share).astype(float)
    elif plan.bootstrap == "bayesian":
        drawn = (-np.log(_uniform(block.mark, plan.seed, tree))) ** plan.temperature
    if not plan.boosted:
        rows = np.flatnonzero(drawn)
        count = drawn[rows]
        return rows, (drawn * y)[rows], count, count
    weight = np.where(y == 1, classes[1], classes[0])
    p = sigmoid(margin)
    g, h = weight * (p - y), weight * p * (1 - p)
    if cut is not None:
        chance = np.minimum(np.sqrt(g * g + 1e-6) / cut, 1.0)
        drawn = (_uniform(block.mark, plan.seed, tree) < chance) / chance
    rows = np.flatnonzero(drawn)
    g, h = np.rint(g * drawn * SCALE)[rows], np.rint(h * drawn * SCALE)[rows]
    return rows, g, h, np.ones(len(rows))


MVS_BINS = 256


def size_counts(block: Block, margin: np.ndarray, plan: TreePlan, classes: tuple[float, float]) -> np.ndarray:
    """Rows by size of their gradient, on a logarithmic grid: (bins, 2) of count and sum, for the mvs threshold."""
    _, g, _, _ = gradients(block, margin, TreePlan(boosted=True), 0, classes)
    size = np.sqrt((g / SCALE) ** 2 + 1e-6)
    at = np.clip(((np.log2(size) + 12) * 16).astype(np.int64), 0, MVS_BINS - 1)
    return np.stack([np.bincount(at, minlength=MVS_BINS), np.rint(np.bincount(at, size, MVS_BINS) * SCALE)], axis=1).astype(float)


def mvs_threshold(counts: np.ndarray, share: float) -> float:
    """The threshold at which min(1, size / threshold) adds up to ``share`` of all rows."""
    n, s = counts[:, 0], counts[:, 1] / SCALE
    below, above = np.cumsum(s), n.sum() - np.cumsum(n)  # a bin and all smaller ones are drawn in proportion
    for i in np.flatnonzero(n):
        if above[i] < share * n.sum():
            cut = below[i] / (share * n.sum() - above[i])
            larger = [s[j] / n[j] for j in np.flatnonzero(n) if j > i]
            if not larger or cut <= larger[0]:
                return float(cut)
    return float("inf")


def node_sums(
    bins: Bins, block: Block, sample: tuple[np.ndarray, ...], at: np.ndarray, wanted: list[int], features: np.ndarray
) -> np.ndarray:
    """(3, nodes, bins): sums of gradient, Hessian and count over the sampled rows that lie ``at`` the wanted nodes."""
    rows, *weights = sample
    slots = np.full(int(max(wanted)) + 2, -1, dtype=np.int64)
    slots[wanted] = np.arange(len(wanted))
    slot = slots[np.minimum(at[rows], len(slots) - 1)]
    on = np.flatnonzero(slot >= 0)
    packed, kind = _pack(weights)
    own = rows[on]
    return histogram(bins, block.columns, block.codes(bins), None if len(own) == len(block.label) else own, slot[on], len(wanted), [w[on] for w in packed], kind, features)


_HIGH, _HALF = float(1 << 36), float(1 << 26)


def _pack(weights: Sequence[np.ndarray]) -> tuple[list[np.ndarray], str]:
    """Gradient, Hessian and count in as few numbers as hold all their sums exactly, and how they are packed."""
    g, h, n = weights
    if h is n and n.sum() < _HALF and ((g == 0) | (g == n)).all():
        return [n + g * _HALF], "counts"
    if n.sum() < 1 << 17 and h.sum() < _HIGH and (h >= 0).all():
        return [g, h + n * _HIGH], "steps"
    return ([g, h], "rows") if (n == 1).all() else ([g, h, n], "plain")


def _unpack(sums: np.ndarray, kind: str) -> np.ndarray:
    if kind in ("plain", "rows"):
        return sums
    out = np.empty((3, *sums.shape[1:]))
    base, high = (_HALF, out[0]) if kind == "counts" else (_HIGH, out[2])
    np.floor(sums[-1] * (1 / base), out=high)
    out[1] = sums[-1] - high * base
    if kind == "counts":
        out[2] = out[1]
    else:
        out[0] = sums[0]
    return out


def histogram(
    bins: Bins, columns: np.ndarray, codes: np.ndarray, rows: np.ndarray | None, slot: np.ndarray, size: int, packed: Sequence[np.ndarray], kind: str,
    features: np.ndarray,
) -> np.ndarray:
    """(3, slots, bins): sums of gradient, Hessian and count by slot and bin over some ``rows`` (None: all) of a block.

    ``columns`` holds the block's bins feature by feature, ``codes`` those of the groups. Many rows a slot are added up group by group.
    """
    packed = [*packed, None] if kind == "rows" else packed
    sums, cells = np.zeros((len(packed), size, bins.total)), np.empty(len(slot), dtype=np.int64)
    together, wanted = len(slot) >= _DENSE * size, set(features.tolist())

    def count(code: np.ndarray, width: int) -> list[np.ndarray]:
        own = code if rows is None else code[rows]
        if size > 1:
            np.multiply(slot, width, out=cells)
            np.add(cells, own, out=cells)
            own = cells
        else:
            own = own.astype(np.int64)
        return [np.bincount(own, w, size * width) for w in packed]

    for code, group in zip(codes, bins.groups, strict=True) if together else ():
        group = group if not wanted.isdisjoint(group) else []
        for i, found in enumerate(count(code, int(np.prod(bins.sizes[group])))) if group else ():
            for j in group:
                found = found.reshape(size, bins.sizes[j], -1)
                found.sum(axis=2, out=sums[i, :, bins.starts[j] : bins.starts[j] + bins.sizes[j]])
                found = found.sum(axis=1)
    for j in () if together else features:
        first, width = bins.starts[j], bins.sizes[j]
        for i, found in enumerate(count(columns[j], width)):
            sums[i, :, first : first + width] = found.reshape(size, width)
    return _unpack(sums, kind)


# --- splits -----------------------------------------------------------------------------------------


def _soft(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0) if l1 else g


def _worth(sums: np.ndarray, plan: TreePlan, classes: tuple[float, float]) -> np.ndarray:
    """What sets of rows are worth as leaves, from (3, ...) sums; a split gains the worth of its parts less that of the whole."""
    g, h, n = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        if plan.criterion == "newton":
            out, below = _soft(g / SCALE, plan.l1), h / SCALE
            below += plan.l2
            out *= out
            out /= below
        elif plan.criterion == "residual":
            out = (g / SCALE) ** 2 / n
        else:
            one, all_ = classes[1] * g, classes[1] * g + classes[0] * (h - g)
            if plan.criterion == "gini":
                out = one * one / all_
            else:
                two = all_ - one
                out = np.where(one > 0, one * np.log(one / all_), 0.0) + np.where(two > 0, two * np.log(two / all_), 0.0)
    fine = np.isfinite(out)
    if not fine.all():
        out[~fine] = 0.0
    return out


def leaf_value(sums: np.ndarray, plan: TreePlan, classes: tuple[float, float]) -> float:
    """Step of a leaf (boosted) or its share of class 1 (forest)."""
    g, h, _ = sums
    if plan.boosted:
        below = h / SCALE + plan.l2
        return float(-plan.rate * _soft(np.float64(g / SCALE), plan.l1) / below) if below > 0 else 0.0
    one, two = classes[1] * g, classes[0] * (h - g)
    return float(one / (one + two)) if one + two > 0 else 0.0


def leaf_values(sums: np.ndarray, plan: TreePlan, classes: tuple[float, float]) -> np.ndarray:
    """``leaf_value`` of many leaves, (leaves, 3) sums."""
    g, h, _ = sums.T
    if plan.boosted:
        above, below = -plan.rate * _soft(g / SCALE, plan.l1), h / SCALE + plan.l2
    else:
        above, below = classes[1] * g, classes[1] * g + classes[0] * (h - g)
    return np.divide(above, below, out=np.zeros(len(sums)), where=below > 0)


def split_gains(
    bins: Bins, sums: np.ndarray, plan: TreePlan, classes: tuple[float, float], features: np.ndarray
) -> np.ndarray:
    """(nodes, bins): gain of sending a feature's bins up to this one to the left; -inf where no split is allowed."""
    j = int(features[0])
    whole = sums[:, :, bins.starts[j] : bins.starts[j] + bins.sizes[j]].sum(axis=2, keepdims=True)
    # Running sums that begin anew with each feature: its first bin takes back what the feature before has come to.
    left = sums.copy()
    left[:, :, bins.starts[1:]] -= np.add.reduceat(sums, bins.starts, axis=2)[:, :, :-1]
    np.cumsum(left, axis=2, out=left)
    right = whole - left
    found = _worth(left, plan, classes)
    found += _worth(right, plan, classes)
    found -= _worth(whole, plan, classes)
    least = max(plan.min_rows, 1)
    good = np.minimum(left[2], right[2]) >= least  # a feature's last bin leaves nothing to the right
    if plan.min_split > 2 * least:
        good &= whole[2] >= plan.min_split
    if plan.min_hessian:
        good &= np.minimum(left[1], right[1]) >= plan.min_hessian * SCALE
    if len(features) < len(bins.sizes):  # other features are not asked
        ask = np.zeros(len(bins.sizes), dtype=bool)
        ask[features] = True
        good &= ask[bins.owner]
    return np.where(good, found, -np.inf)


def _feature_order(d: int, paths: list[int] | np.ndarray, plan: TreePlan, tree: int) -> np.ndarray:
    """(nodes, features): the random order in which a node draws its features."""
    path = paths.astype(np.uint64) if isinstance(paths, np.ndarray) else np.array([p % (1 << 63) for p in paths], dtype=np.uint64)
    seed = _mix(np.array([plan.seed * 1_000_003 + tree], dtype=np.uint64))[0]
    return np.argsort(_mix(_mix(path ^ seed)[:, None] ^ np.arange(d, dtype=np.uint64)[None, :]), axis=1)


def _among_some(bins: Bins, gains: np.ndarray, paths: list[int], plan: TreePlan, tree: int) -> np.ndarray:
    """``gains`` with the features that a node does not draw blotted out.

    Features come in random order; the first sqrt(features) count, and if none of them can split, the next one that can.
    """
    d = len(bins.sizes)
    count = max(1, int(np.sqrt(d)))
    best = np.maximum.reduceat(gains, bins.starts, axis=1)
    order = _feature_order(d, paths, plan, tree)
    ranked = np.take_along_axis(best, order, axis=1) > _LEAST_GAIN
    first = np.where(ranked.any(axis=1), ranked.argmax(axis=1), 0)
    upto = np.maximum(count - 1, first)
    rank = np.argsort(order, axis=1)
    return np.where(np.repeat(rank <= upto[:, None], bins.sizes, axis=1), gains, -np.inf)


def best_splits(
    bins: Bins, sums: np.ndarray, paths: list[int], plan: TreePlan, classes: tuple[float, float], features: np.ndarray, tree: int
) -> list[tuple[list[float], float, int, int, list[float] | None]]:
    """Per node (own sums, gain, feature, last bin of the left side, sums of the left side); feature -1 where nothing is gained.

    With weights of the tree's own sample, ``classes`` comes from the root's sums, and the root looks at its own.
    """
    j, size = int(features[0]), sums.shape[1]
    whole = sums[:, :, bins.starts[j] : bins.starts[j] + bins.sizes[j]].sum(axis=2).T
    if plan.weights == "subsample" and paths == [1]:
        classes = _own_classes(whole[0])
    gain, at = np.zeros(size), np.full(size, -1)
    if plan.grow == "oblivious":
        together, able = np.zeros(bins.total), np.flatnonzero(whole[:, 2] >= 2)
        for start in range(0, len(able), _TOGETHER):
            gains = split_gains(bins, sums[:, able[start : start + _TOGETHER]], plan, classes, features)
            together += np.rint(np.maximum(gains, 0.0) * SCALE).sum(axis=0)
        best = int(together.argmax())
        if together[best] > _LEAST_GAIN:  # nodes of fewer than two rows stay leaves
            gain[able], at[able] = together[best] / SCALE, best
    else:
        for start in range(0, size, _TOGETHER):
            part = slice(start, start + _TOGETHER)
            gains = split_gains(bins, sums[:, part], plan, classes, features)
            if plan.node_features != "all":
                gains = _among_some(bins, gains, paths[part], plan, tree)
            best = gains.argmax(axis=1)
            top = gains[np.arange(len(best)), best]
            factor = 0.5 if plan.criterion == "newton" else 1.0
            good = np.flatnonzero((top > _LEAST_GAIN) & (top * factor > plan.min_gain))
            gain[start + good], at[start + good] = top[good], best[good]
    out = []
    for node, (w, one, b) in enumerate(zip(whole.tolist(), gain.tolist(), at.tolist(), strict=True)):
        if b < 0:
            out.append((w, 0.0, -1, 0, None))
        else:
            j = int(bins.owner[b])
            out.append((w, one, j, int(b - bins.starts[j]), sums[:, node, bins.starts[j] : b + 1].sum(axis=1).tolist()))
    return out


def sparse_splits(
    bins: Bins, columns: np.ndarray, slot: np.ndarray, weights: Sequence[np.ndarray], paths: list[int], plan: TreePlan,
    classes: tuple[float, float], features: np.ndarray, tree: int,
) -> list[tuple[list[float], float, int, int, list[float] | None]]:
    """What ``best_splits`` finds but for the sums of the left sides, from the bins that the nodes' rows lie in: costs by rows, not by nodes times bins.

    A bin without rows splits as the one before it, which comes first. Of features that a node draws in random order, the first ones
    are looked at, and the others only if none of these can split.
    """
    size = len(paths)
    whole = np.stack([np.bincount(slot, w, size) for w in weights], axis=-1)
    if plan.weights == "subsample" and paths == [1]:
        classes = _own_classes(whole[0])
    gain, at = np.full(size, -np.inf), np.zeros(size, dtype=np.int64)
    able = (whole[:, 2] >= max(plan.min_split, 2 * max(plan.min_rows, 1))) & ((whole[:, 0] > 0) & (whole[:, 0] < whole[:, 1]) if not plan.boosted else True)
    if plan.node_features == "all":
        draws = [np.broadcast_to(features, (size, len(features)))]
    else:
        order, count = _feature_order(len(bins.sizes), paths, plan, tree), max(1, int(np.sqrt(len(bins.sizes))))
        draws = [order[:, :count], *[order[:, i : i + count] for i in range(count, order.shape[1], count)]]
    for number, drawn in enumerate(draws):
        rows = np.flatnonzero(able[slot])
        if not len(rows):
            break
        found, place = _sparse_gains(bins, columns, rows, slot[rows], [w[rows] for w in weights], whole, drawn, plan, classes)
        if number == 0:
            top = np.full(size, -np.inf)
            np.maximum.at(top, place[0], found)
            best = found == top[place[0]]
            at[:] = bins.total
            np.minimum.at(at, place[0][best], place[1][best])
            gain = top
        else:  # the first feature in the order that can split
            good = np.flatnonzero(found > _LEAST_GAIN)
            good = good[np.lexsort((place[1][good], -found[good], place[2][good], place[0][good]))]
            who, first = np.unique(place[0][good], return_index=True)
            gain[who], at[who] = found[good[first]], place[1][good[first]]
        able &= ~(gain > _LEAST_GAIN)
    factor = 0.5 if plan.criterion == "newton" else 1.0
    good = (gain > _LEAST_GAIN) & (gain * factor > plan.min_gain)
    j = np.where(good, bins.owner[np.minimum(at, bins.total - 1)], -1)
    cut = np.where(good, at - bins.starts[j], 0)
    return list(zip(whole.tolist(), np.where(good, gain, 0.0).tolist(), j.tolist(), cut.tolist(), [None] * size, strict=True))


def _sparse_gains(
    bins: Bins, columns: np.ndarray, rows: np.ndarray, slot: np.ndarray, weights: list[np.ndarray], whole: np.ndarray, drawn: np.ndarray,
    plan: TreePlan, classes: tuple[float, float],
) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Gains of sending a drawn feature's bins up to one that holds rows to the left, with their node, bin and place in the draw."""
    count = drawn.shape[1]
    feature = drawn[slot]
    key = ((slot[:, None] * count + np.arange(count)) * _STRIDE + columns[feature, rows[:, None]]).ravel()
    g, _, n = weights
    if not plan.boosted and len(n) and n.max() < 16 and ((g == 0) | (g == n)).all():
        # Small counts are sorted along with their keys.
        mixed = key.reshape(len(rows), count) * 32
        mixed += (n * 2 + (g > 0)).astype(np.int64)[:, None]
        mixed = np.sort(mixed.ravel())
        key = mixed >> 5
        ends = np.flatnonzero(np.concatenate([key[1:] != key[:-1], [True]]))
        rows_of, ones_of = mixed >> 1 & 15, mixed & 1
        total = np.cumsum(rows_of)[ends]
        sums = np.stack([np.cumsum(rows_of * ones_of)[ends], total, total]).astype(np.float64)
        key = key[ends]
    else:
        order = np.argsort(key)
        key = key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, row = key[starts], order // count
        sums = np.cumsum(np.stack([np.add.reduceat(w[row], starts) for w in weights]), axis=1)
    group = key // _STRIDE
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    before = np.concatenate([np.zeros((3, 1)), sums], axis=1)[:, first]
    left = sums - np.repeat(before, np.diff(np.append(first, len(group))), axis=1)
    node = group // count
    own = whole.T[:, node]
    right = own - left
    gain = _worth(left, plan, classes) + _worth(right, plan, classes) - _worth(own, plan, classes)
    good = (left[2] >= max(plan.min_rows, 1)) & (right[2] >= max(plan.min_rows, 1)) & (own[2] >= plan.min_split)
    if plan.min_hessian:
        good &= (left[1] >= plan.min_hessian * SCALE) & (right[1] >= plan.min_hessian * SCALE)
    rank = group % count
    return np.where(good, gain, -np.inf), (node, bins.starts[drawn[node, rank]] + key % _STRIDE, rank)


def _counted_gains(
    flat: np.ndarray, base: np.ndarray, slot: np.ndarray, code: np.ndarray, whole: tuple[np.ndarray, np.ndarray], drawn: np.ndarray, bins: Bins,
    plan: TreePlan, classes: tuple[float, float],
) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``_sparse_gains`` for rows drawn fewer than 16 times: ``code`` is twice the count, plus the class; ``whole`` the rows of class 1 and all rows by node.

    ``flat`` holds the bins row by row and ``base`` where each row begins.
    """
    size, count = drawn.shape
    if size * _STRIDE <= 2 * len(slot):  # more rows than cells: add up, a place of the draw after the other
        weight = (code >> 1) + (code >> 1) * (code & 1) * _HALF
        cells = np.empty((size, count, _STRIDE))
        first = slot << 8
        for i in range(count):
            at = drawn[:, i].take(slot)
            at += base
            cells[:, i] = np.bincount(first + flat.take(at), weight, size * _STRIDE).reshape(size, _STRIDE)
        cells = cells.ravel()
        key = np.flatnonzero(cells)
        packed = cells[key].astype(np.int64)
        ones, rows = np.cumsum(packed >> 26), np.cumsum(packed & (1 << 26) - 1)
    else:
        kind = np.int32 if size * count << 13 < 1 << 31 else np.int64
        mixed = np.empty((count, len(slot)), dtype=kind)
        first = (slot * (count << 13) + code).astype(kind)
        for i in range(count):
            at = drawn[:, i].take(slot)
            at += base
            np.left_shift(flat.take(at), 5, out=mixed[i], dtype=kind)
            mixed[i] += first
            mixed[i] += i << 13
        mixed = np.sort(mixed, axis=None)
        key = mixed >> 5
        ends = np.flatnonzero(np.concatenate([key[1:] != key[:-1], [True]]))
        values = np.arange(32, dtype=np.int64) >> 1
        total = np.cumsum((values + ((values * (np.arange(32) & 1)) << 32)).take(mixed & 31))[ends]
        ones, rows, key = total >> 32, total & (1 << 32) - 1, key[ends].astype(np.int64)
    group = key >> 8
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    lengths = np.diff(np.append(first, len(group)))
    one, all_ = (x - np.repeat(np.where(first > 0, x[first - 1], 0), lengths) for x in (ones, rows))
    one, all_ = one.astype(np.float64), all_.astype(np.float64)
    node = np.repeat(group[first] // count, lengths)
    other, rest = whole[0][node] - one, whole[1][node] - all_
    gain = _worth((one, all_, all_), plan, classes) + _worth((other, rest, rest), plan, classes) - _worth((*whole, whole[1]), plan, classes)[node]
    least = max(plan.min_rows, 1)
    good = rest >= least
    if least > 1:
        good &= all_ >= least
    rank = np.repeat(group[first] % count, lengths)
    place = np.repeat(bins.starts[drawn[group[first] // count, group[first] % count]], lengths) + (key & 255)
    return np.where(good, gain, -np.inf), (node, place, rank)


def _grow_counted(bins: Bins, block: Block, rows: np.ndarray, code: np.ndarray, plan: TreePlan, number: int, classes: tuple[float, float]) -> tuple[Tree, np.ndarray]:
    """The tree that ``Growth`` would take from ``sparse_splits``, level by level in arrays; rows that have come to a leaf are not looked at again."""
    flat, d = block.by_row, len(bins.sizes)
    draw, least = max(1, int(np.sqrt(d))), max(plan.min_split, 2 * max(plan.min_rows, 1))
    drawn_rows, ones = (code >> 1).astype(np.float64), ((code >> 1) * (code & 1)).astype(np.float64)
    place, live, slot = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows)), np.zeros(len(rows), dtype=np.int64)
    base, paths, depth, done = rows * d, np.ones(1, dtype=np.int64), 0, 0
    levels: dict[str, list[np.ndarray]] = {f: [] for f in Tree.FIELDS}
    while len(paths):
        size = len(paths)
        whole = np.bincount(slot, ones[live], size), np.bincount(slot, drawn_rows[live], size)
        if depth == 0 and plan.weights == "subsample":
            classes = _own_classes((whole[0][0], whole[1][0]))
        gain, at = np.full(size, -np.inf), np.zeros(size, dtype=np.int64)
        able = (whole[1] >= least) & (whole[0] > 0) & (whole[0] < whole[1])
        if plan.depth is not None and depth >= plan.depth:
            able[:] = False
        asked = np.flatnonzero(able)
        order = _feature_order(d, paths[asked], plan, number) if len(asked) else None
        for start in range(0, d if len(asked) else 0, draw):
            own = np.flatnonzero(able[asked])
            nodes = asked[own]
            if not len(nodes):
                break
            new = np.full(size, -1)
            new[nodes] = np.arange(len(nodes))
            fresh = new[slot]
            hit = np.flatnonzero(fresh >= 0)
            found, (node, cell, rank) = _counted_gains(
                flat, base[live[hit]], fresh[hit], code[live[hit]], (whole[0][nodes], whole[1][nodes]), order[own, start : start + draw], bins, plan, classes
            )
            if start == 0:
                heads = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
                top = np.maximum.reduceat(found, heads)
                best = np.flatnonzero(found == np.repeat(top, np.diff(np.append(heads, len(node)))))
                first = np.full(len(nodes), bins.total)
                np.minimum.at(first, node[best], cell[best])
                gain[nodes], at[nodes] = top, first
            else:  # the first feature in the order that can split
                good = np.flatnonzero(found > _LEAST_GAIN)
                good = good[np.lexsort((cell[good], -found[good], rank[good], node[good]))]
                who, first = np.unique(node[good], return_index=True)
                gain[nodes[who]], at[nodes[who]] = found[good[first]], cell[good[first]]
            able &= ~(gain > _LEAST_GAIN)
        split = (gain > _LEAST_GAIN) & (gain > plan.min_gain)
        inner, known = np.flatnonzero(split), np.full(size, -1)
        known[inner] = done + size + 2 * np.arange(len(inner))
        feature = np.where(split, bins.owner[np.minimum(at, bins.total - 1)], -1)
        cut = np.where(split, at - bins.starts[feature], 0)
        value = classes[1] * whole[0], classes[0] * (whole[1] - whole[0])
        with np.errstate(invalid="ignore"):
            share = np.where(value[0] + value[1] > 0, value[0] / (value[0] + value[1]), 0.0)
        for name, x in zip(Tree.FIELDS, (feature, cut, known, np.where(split, known + 1, -1), share, whole[1], np.full(size, depth), np.where(split, gain, 0.0)), strict=True):
            levels[name].append(x)
        on = np.flatnonzero(split[slot])
        live, node = live[on], slot[on]
        place[live] = known[node] + (flat.take(base[live] + feature[node]) > cut[node])
        done += size
        slot = place[live] - done
        paths = child_paths(paths[inner])
        depth += 1
    tree = Tree(**{f: np.concatenate(x) for f, x in levels.items()})
    return tree, tree.value[place]


def _own_classes(sums: np.ndarray) -> tuple[float, float]:
    one, all_ = float(sums[0]), float(sums[1])
    return (all_ / (2 * (all_ - one)) if all_ > one else 1.0, all_ / (2 * one) if one else 1.0)


# --- trees -----------------------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes from the root on: feature (-1: leaf), last bin of the left side, children, value, rows, depth and gain of the split."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    rows: np.ndarray
    depth: np.ndarray
    gain: np.ndarray

    FIELDS = ("feature", "cut", "left", "right", "value", "rows", "depth", "gain")
    SCORING = ("feature", "cut", "left", "value")

    def places(self, rows: np.ndarray, depth: int | None = None, min_split: int = 0, some: np.ndarray | None = None) -> np.ndarray:
        """Node of each row of bins, or of ``some`` of them by number; the tree ends at ``depth`` and at nodes of fewer than ``min_split`` rows."""
        feature, left = self.feature.astype(np.int64), self.left.astype(np.int64)
        if depth is not None or min_split:
            stop = self.rows < min_split
            feature = np.where(stop if depth is None else stop | (self.depth >= depth), -1, feature)
        flat, row, column = (rows.T.reshape(-1), 1, len(rows)) if rows.flags.f_contiguous else (rows.reshape(-1), rows.shape[1], 1)
        start = np.arange(len(rows)) if some is None else some
        at = np.zeros(len(start), dtype=np.int64)
        if feature[0] < 0:
            return at
        first, node, on = start * row if row > 1 else start, 0, slice(None)
        while len(first):
            node = left[node] + (flat.take(first + feature[node] * column) > self.cut[node])
            at[on] = node
            more = np.flatnonzero(feature[node] >= 0)
            if len(more) < len(node):
                on, node, first = more if isinstance(on, slice) else on[more], node[more], first[more]
        return at

    def scores(self, rows: np.ndarray, **limits) -> np.ndarray:
        return self.value[self.places(rows, **limits)]


def child_path(path: int, side: int) -> int:
    """A number for each place in a tree, from which nodes draw their features."""
    return path * 2 + side if path < 1 << 40 else hash((path, side)) & (1 << 60) - 1


def child_paths(paths: np.ndarray) -> np.ndarray:
    """``child_path`` of both children of every place, left and right in turn."""
    out = np.stack([paths * 2, paths * 2 + 1], axis=1)
    for i in np.flatnonzero(paths >= 1 << 40).tolist():
        out[i] = [child_path(int(paths[i]), side) for side in (0, 1)]
    return out.ravel()


class Growth:
    """One tree as it grows: asks for the sums of nodes (``wanted``) and takes their best splits until it is ``done``."""

    def __init__(self, plan: TreePlan, tree: int, n_features: int, classes: tuple[float, float]):
        self.plan, self.tree, self.classes = plan, tree, classes
        self.features = np.arange(n_features)
        if plan.feature_share < 1:
            draw = _uniform(np.arange(n_features), plan.seed, tree, 7)
            self.features = np.sort(np.argsort(draw)[: max(1, round(plan.feature_share * n_features))])
        # By node; sums are None until they are known.
        self.sums: list[list[float] | None] = [None]
        self.left_sums: list[list[float] | None] = [None]
        self.gain, self.feature, self.cut = [0.0], [-1], [0]
        self.left, self.depth, self.path = [-1], [0], [1]
        self.wanted = [0]
        self.whole_values: np.ndarray | None = None

    def partial(self) -> Tree:
        """The tree so far: nodes whose children are known are inner nodes."""
        left, none = np.array(self.left), np.zeros(len(self.left))
        return Tree(np.where(left < 0, -1, self.feature), np.array(self.cut), left, left + 1, none, none, np.array(self.depth), none)

    def _may_split(self, node: int) -> bool:
        return self.feature[node] >= 0 and not self.ends(node)

    def ends(self, node: int) -> bool:
        """Whether a node lies at the depth limit; only its own sums count then."""
        return self.plan.depth is not None and self.depth[node] >= self.plan.depth

    def _open(self, node: int) -> None:
        """Two children for a node, to be summed next; those at the depth limit are known from their parent's sums."""
        self.left[node] = len(self.left)
        for side in (0, 1):
            self.left.append(-1)
            self.gain.append(0.0)
            self.feature.append(-1)
            self.cut.append(0)
            self.left_sums.append(None)
            self.depth.append(self.depth[node] + 1)
            own = self.left_sums[node] if self.ends(len(self.left) - 1) else None
            self.sums.append(own if own is None or not side else [w - x for w, x in zip(self.sums[node], own, strict=True)])
            self.path.append(child_path(self.path[node], side))
            if own is None:
                self.wanted.append(len(self.left) - 1)

    def take(self, found: list[tuple[list[float], float, int, int, list[float] | None]]) -> None:
        """Sums and best splits of the wanted nodes, in their order."""
        fresh, self.wanted = self.wanted, []
        if fresh == [0] and self.plan.weights == "subsample":
            self.classes = _own_classes(np.array(found[0][0]))
        for node, one in zip(fresh, found, strict=True):
            self.sums[node], self.gain[node], self.feature[node], self.cut[node], self.left_sums[node] = one
        if self.plan.grow != "best" or self.plan.leaves is None:
            for node in fresh:
                if self._may_split(node):
                    self._open(node)
        else:
            self.chosen = self._best_first()

    def _best_first(self) -> list[int]:
        """Nodes to split, highest gain first, up to the number of leaves; opens those whose children are not summed yet."""
        chosen, heap, leaves = [], [(-self.gain[0], 0)] if self._may_split(0) else [], 1
        while heap and leaves < self.plan.leaves:
            _, node = heapq.heappop(heap)
            chosen.append(node)
            leaves += 1
            if self.left[node] < 0:
                self._open(node)
            elif self.sums[self.left[node]] is not None:
                for child in (self.left[node], self.left[node] + 1):
                    if self._may_split(child):
                        heapq.heappush(heap, (-self.gain[child], child))
        return chosen

    @property
    def done(self) -> bool:
        return not self.wanted

    def finish(self) -> Tree:
        """The grown tree; nodes that were summed but not chosen go."""
        if self.plan.grow != "best" or self.plan.leaves is None:
            return self._whole()
        split = set(self.chosen)
        order, out = [0], {f: [] for f in Tree.FIELDS}
        for node in order:  # grows while it is read
            inner = node in split
            out["feature"].append(self.feature[node] if inner else -1)
            out["cut"].append(self.cut[node] if inner else 0)
            out["left"].append(len(order) if inner else -1)
            out["right"].append(len(order) + 1 if inner else -1)
            out["value"].append(leaf_value(self.sums[node], self.plan, self.classes))
            out["rows"].append(self.sums[node][2])
            out["depth"].append(self.depth[node])
            out["gain"].append(self.gain[node] if inner else 0.0)
            if inner:
                order += [self.left[node], self.left[node] + 1]
        self.values_ = dict(zip(order, out["value"], strict=True))
        whole = ("feature", "cut", "left", "right", "depth")
        return Tree(**{f: np.array(v, dtype=np.int64 if f in whole else np.float64) for f, v in out.items()})


    def _whole(self) -> Tree:
        """The tree where every opened node stays: its nodes are in order as they came."""
        left, sums = np.array(self.left), np.array(self.sums)
        inner = left >= 0
        feature, cut, gain = (np.where(inner, x, none) for x, none in ((self.feature, -1), (self.cut, 0), (self.gain, 0.0)))
        self.whole_values = leaf_values(sums, self.plan, self.classes)
        return Tree(feature, cut, left, np.where(inner, left + 1, -1), self.whole_values, sums[:, 2], np.array(self.depth), gain)

    def values(self) -> np.ndarray:
        """Value of each summed node in the finished tree; nodes that have gone count as what is left above them."""
        if self.whole_values is not None:
            return self.whole_values
        out = np.zeros(len(self.left))
        for node, left in enumerate(self.left):  # parents come first
            out[node] = self.values_.get(node, out[node])
            if left >= 0:
                out[left : left + 2] = out[node]
        return out


_KEPT = 256  # nodes whose sums are kept, so that one child's are their parent's less its sibling's
_FEW = 32  # rows below which a node is split by its rows and not by all bins


def grow_tree(bins: Bins, block: Block, sample: tuple[np.ndarray, ...], tree: Growth) -> tuple[Tree, np.ndarray]:
    """One tree over the rows of a block, and the score of each row of the sample. Rows move on from node to node as it grows."""
    rows, *weights = sample
    plan = tree.plan
    if not plan.boosted and plan.node_features != "all" and len(rows):
        ones, _, count = weights
        if count.max() < 16 and ((ones == 0) | (ones == count)).all():
            return _grow_counted(bins, block, rows, (count * 2 + (ones > 0)).astype(np.int64), plan, tree.tree, tree.classes)
    columns, codes, kept = block.columns, block.codes(bins), {}
    every_row = len(rows) == columns.shape[1]
    packed, kind = _pack(weights)
    place = np.zeros(len(rows), dtype=np.int64)

    def move(left: np.ndarray) -> None:
        on = np.flatnonzero(left.take(place) >= 0)
        node = place[on]
        feature, cut, own = np.array(tree.feature), np.array(tree.cut), on if every_row else rows[on]
        if plan.grow == "oblivious" and len(node):  # one split for a whole level
            place[on] = left.take(node) + (columns[feature[node[0]]].take(own) > cut[node[0]])
        else:
            place[on] = left.take(node) + (columns.reshape(-1).take(own + feature.take(node) * columns.shape[1]) > cut.take(node))

    while not tree.done:
        wanted, left = tree.wanted, np.array(tree.left)
        if wanted != [0]:
            move(left)
        slots = np.full(len(left), -1)
        slots[wanted] = np.arange(len(wanted))
        slot, paths = slots[place], [tree.path[n] for n in wanted]
        on = np.flatnonzero(slot >= 0)
        sizes = np.bincount(slot[on], minlength=len(wanted))

        def some(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rows in some slots, by their number in the sample, and their slots, numbered anew."""
            if len(which) == len(wanted):
                return on, slot[on]
            new = np.full(len(wanted), -1)
            new[which] = np.arange(len(which))
            fresh = new[slot[on]]
            hit = np.flatnonzero(fresh >= 0)
            return on[hit], fresh[hit]

        def dense(which: np.ndarray) -> np.ndarray:
            hit, at = some(which)
            whole = len(hit) == len(rows)
            where = None if whole and every_row else rows if whole else hit if every_row else rows[hit]
            return histogram(bins, columns, codes, where, at, len(which), packed if whole else [w[hit] for w in packed], kind, tree.features)

        def sparse(which: np.ndarray) -> list[tuple]:
            hit, at = some(which)
            own = columns[:, hit if every_row else rows[hit]]
            return sparse_splits(bins, own, at, [w[hit] for w in weights], [paths[i] for i in which], plan, tree.classes, tree.features, tree.tree)

        every = np.arange(len(wanted))
        if all(tree.ends(n) for n in wanted):
            whole = np.stack([np.bincount(slot[on], w[on], len(wanted)) for w in weights], axis=-1)
            found = [(w, 0.0, -1, 0, None) for w in whole.tolist()]
        elif plan.node_features != "all":
            found = sparse(every)
        elif plan.grow == "oblivious" or len(wanted) <= _KEPT:
            sums = np.empty((3, len(wanted), bins.total))
            parents = {int(left[n]): n for n in kept if left[n] >= 0 and slots[left[n]] >= 0}
            less = [i + (sizes[i + 1] < sizes[i]) for i in range(0, len(wanted), 2) if wanted[i] in parents]
            rest = np.array(sorted({*less, *(i for i, n in enumerate(wanted) if n not in parents and n - 1 not in parents)}), dtype=np.int64)
            sums[:, rest] = dense(rest)
            for i in less:
                other = i + 1 if wanted[i] in parents else i - 1
                before, k = kept[parents[wanted[min(i, other)]]]
                np.subtract(before[:, k], sums[:, i], out=sums[:, other])
            # The sums of a level stay together until no child needs them.
            kept = {n: one for n, one in kept.items() if left[n] < 0} if plan.grow == "best" else {}
            kept = {**kept, **{n: (sums, k) for k, n in enumerate(wanted)}} if len(wanted) <= _KEPT else {}
            found = best_splits(bins, sums, paths, plan, tree.classes, tree.features, tree.tree)
        else:
            found, kept = [None] * len(wanted), {}
            small, large = np.flatnonzero(sizes < _FEW), np.flatnonzero(sizes >= _FEW)
            if len(small):
                for i, one in zip(small.tolist(), sparse(small), strict=True):
                    found[i] = one
            for start in range(0, len(large), _KEPT):
                part = large[start : start + _KEPT]
                splits = best_splits(bins, dense(part), [paths[i] for i in part], plan, tree.classes, tree.features, tree.tree)
                for i, one in zip(part.tolist(), splits, strict=True):
                    found[i] = one
        tree.take(found)
    move(np.array(tree.left))
    return tree.finish(), tree.values()[place]


@dataclass
class Ensemble:
    """Trees and the margin they start from."""

    boosted: bool
    start: float
    trees: list[Tree] = field(default_factory=list)

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for tree in self.trees:
            total += tree.scores(rows)
        return sigmoid(self.start + total) if self.boosted else total / max(len(self.trees), 1)

    def gains(self, n_features: int) -> np.ndarray:
        """Share of the total gain that each feature has brought."""
        out = np.zeros(n_features)
        for tree in self.trees:
            inner = tree.feature >= 0
            np.add.at(out, tree.feature[inner], tree.gain[inner])
        return out / out.sum() if out.sum() > 0 else out

    def pack(self, fields: Sequence[str] = Tree.FIELDS) -> dict[str, Any]:
        """As JSON values; node arrays of all trees one after another. Right children follow their sisters."""
        out = {"boosted": self.boosted, "start": self.start, "sizes": [len(t.feature) for t in self.trees]}
        for name in (f for f in fields if f != "right"):
            joined = np.concatenate([getattr(t, name) for t in self.trees]) if self.trees else np.zeros(0)
            out[name] = base64.b64encode(zlib.compress(joined.astype(_KINDS[name]).tobytes(), 1)).decode()
        return out

    @classmethod
    def unpack(cls, packed: dict[str, Any], fields: Sequence[str] = Tree.FIELDS) -> Ensemble:
        """The packed trees, of one ensemble or of its parts in their order; ``fields`` that were not packed or are not wanted are empty."""
        if "parts" in packed:
            found = [cls.unpack(one, fields) for one in packed["parts"]]
            return cls(found[0].boosted, found[0].start, [tree for one in found for tree in one.trees])
        ends = np.cumsum(packed["sizes"])[:-1] if packed["sizes"] else []
        parts = {name: [np.zeros(0)] * len(packed["sizes"]) for name in Tree.FIELDS}
        for name in (f for f in fields if f in packed and f != "right"):
            parts[name] = np.split(np.frombuffer(zlib.decompress(base64.b64decode(packed[name])), dtype=_KINDS[name]), ends)
        if "right" in fields:
            parts["right"] = [np.where(left < 0, left, left + 1) for left in parts["left"]]
        trees = [Tree(**{f: parts[f][i] for f in Tree.FIELDS}) for i in range(len(packed["sizes"]))]
        return cls(packed["boosted"], packed["start"], trees)


# How node arrays are packed, and held when they are read back: a deep forest on many rows has as many nodes as rows.
_KINDS = {"feature": "<i4", "cut": "<u1", "left": "<i4", "value": "<f8", "rows": "<f4", "depth": "<i2", "gain": "<f8"}
