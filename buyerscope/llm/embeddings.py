"""Near-duplicate vectors by a forest of random-projection trees.

Every tree splits the vectors again and again by a random projection; vectors near a split go to both sides (spill). A node tries a
few directions and cuts and takes the cut with the least of its sample nearby, so that dense groups are rarely cut through, and it is
not split at all where its spread is no wider than that of linked pairs. Vectors that meet in a leaf of any tree are compared exactly, and
each pair is counted in the first leaf it shares.

A pair is missed only if every tree parts it. The number of trees follows from the share of pairs at the threshold that each tree is
measured to part around every vector of the sample (``MISS``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buyerscope.llm.common import share, table
from buyerscope.llm.components import connected_components, merge_links
from buyerscope.storage import write_once

LEAF_ROWS = 1_024  # rows a leaf should hold
BLOCK_ROWS = 2_048  # leaves above this are compared block by block in several tasks
SAMPLE_ROWS = (8_192, 262_144)  # bounds of the sample that fits the splits; one row in 64 in between
SAMPLE_BYTES = 1 << 28  # the sample is smaller where vectors are long
NODE_SAMPLE = 32  # a node with fewer sample rows is not split
SPILL = 0.5  # margin on either side of a split, in standard deviations of a threshold pair's projected difference
LEAST_SPREAD = 1.5  # spread, in the same unit, below which a node is not split
DIRECTIONS = 4  # directions that the nodes of one level choose from
CUTS = (0.5, 0.45, 0.55, 0.4, 0.6, 0.35, 0.65)  # quantiles a cut may lie at
MISS = 1e-10  # share of threshold pairs that all trees together may part, as measured
TREES = (8, 64)  # bounds of the number of trees
PROBES = 4_096  # sample vectors around which the parted share is measured
PARTNERS = 8  # pairs at the threshold per probe and tree


class Tree:
    """Splits of one tree over unit vectors: node -> (direction, cut); children of n are 2n + 1 and 2n + 2.

    All nodes of a level choose among the same few random directions, so a tree keeps a seed and two numbers per node.
    """

    def __init__(self, sample: np.ndarray, depth: int, unit: float, seed: int):
        self.depth, self.unit, self.seed, self.dim, self.splits = depth, unit, seed, sample.shape[1], {}
        self.margin = SPILL * unit
        spread = self.project(sample)
        todo = [(0, np.arange(len(sample)), 0)]
        while todo:
            node, rows, level = todo.pop()
            if level == depth or len(rows) < NODE_SAMPLE:
                continue
            best = None
            for k in range(level * DIRECTIONS, (level + 1) * DIRECTIONS):
                values = np.sort(spread[rows, k])
                if values.std() < LEAST_SPREAD * unit:
                    continue
                for q in CUTS:
                    cut = float(values[int(q * (len(values) - 1))])
                    near = np.searchsorted(values, cut + unit, "right") - np.searchsorted(values, cut - unit, "left")
                    if best is None or near < best[0]:
                        best = (near, k, cut)
            if best is None:
                continue
            _, k, cut = best
            self.splits[node] = (k, cut)
            for child, part in ((2 * node + 1, spread[rows, k] <= cut + self.margin), (2 * node + 2, spread[rows, k] >= cut - self.margin)):
                if part.sum() < len(rows):  # else the split parts nothing
                    todo.append((child, rows[part], level + 1))

    def project(self, vectors: np.ndarray) -> np.ndarray:
        directions = np.random.default_rng([self.seed, self.dim]).standard_normal((self.dim, max(self.depth, 1) * DIRECTIONS))
        return vectors @ (directions / np.linalg.norm(directions, axis=0))

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that a row reaches."""
        spread = self.project(vectors)
        out, todo = [], [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if node not in self.splits or not len(rows):
                out.append((rows, np.full(len(rows), node, dtype=np.int64)))
                continue
            k, cut = self.splits[node]
            todo.append((2 * node + 1, rows[spread[rows, k] <= cut + self.margin]))
            todo.append((2 * node + 2, rows[spread[rows, k] >= cut - self.margin]))
        return np.concatenate([r for r, _ in out]), np.concatenate([n for _, n in out])

    def parts(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which pairs of rows share no leaf."""
        one, two = (set(zip(*map(np.ndarray.tolist, self.leaves(x)), strict=True)) for x in (left, right))
        out = np.ones(len(left), dtype=bool)
        out[[r for r, _ in one & two]] = False
        return out


def grow_forest(sample: np.ndarray, depth: int, threshold: float) -> list[Tree]:
    """Trees until the measured share of missed threshold pairs is at most ``MISS``.

    Around each probe, made-up vectors at exactly the threshold count how often a tree parts such a pair there; a pair is missed if all
    trees part it, so a probe's share goes down as a power with the number of trees. Probes in dense groups weigh most.
    """
    unit = float(np.sqrt((2 - 2 * threshold) / sample.shape[1]))
    if depth == 0:
        return [Tree(sample, 0, unit, 0)]
    rng = np.random.default_rng(11)
    probes = sample[rng.permutation(len(sample))[:PROBES]]
    trees, parted = [], np.zeros(len(probes))
    while len(trees) < TREES[1]:
        trees.append(Tree(sample, depth, unit, len(trees)))
        if len(trees) <= TREES[0]:
            for _ in range(PARTNERS):
                away = rng.standard_normal(probes.shape)
                away -= (away * probes).sum(axis=1, keepdims=True) * probes
                away /= np.linalg.norm(away, axis=1, keepdims=True)
                parted += trees[-1].parts(probes, threshold * probes + np.sqrt(1 - threshold**2) * away)
        # One more parted pair than seen, so that nothing counts as impossible.
        share = (parted + 1) / (PARTNERS * min(len(trees), TREES[0]) + 1)
        if len(trees) >= TREES[0] and (share ** len(trees)).mean() <= MISS:
            break
    return trees


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def fit_forest(vectors: DataFrame, threshold: float, n_rows: int) -> dict[int, list[Tree]]:
    """Trees per number of dimensions, fitted on a sample (lowest hashes of the vectors) that is bounded in rows and bytes."""
    longest = vectors.agg(F.max(F.size("vector"))).first()[0]
    size = max(1, min(max(SAMPLE_ROWS[0], n_rows // 64), SAMPLE_ROWS[1], SAMPLE_BYTES // (8 * longest)))
    picked = vectors.select("vector").orderBy(F.xxhash64("vector")).limit(size).toPandas()["vector"]
    depth = max(0, int(np.ceil(np.log2(max(n_rows, 1) / LEAF_ROWS) * 1.25)))  # spill makes children larger than halves
    forest = {}
    for dim, rows in picked.groupby(picked.map(len)):
        forest[int(dim)] = grow_forest(_unit(np.stack(rows.to_numpy()).astype(np.float64)), depth, threshold)
    return forest


def _trees(forest: dict[int, list[Tree]], dim: int) -> list[Tree]:
    """Trees for a number of dimensions; one that the sample does not know has a single leaf."""
    return forest.get(dim) or [Tree(np.zeros((0, dim)), 0, 1.0, 0)]


def _route(vectors: np.ndarray, trees: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) over all trees, by row; a leaf's number is unique over the forest and grows with the tree."""
    rows, leaves = [], []
    for number, tree in enumerate(trees):
        r, n = tree.leaves(vectors)
        rows.append(r)
        leaves.append(n * len(trees) + number)
    rows, leaves = np.concatenate(rows), np.concatenate(leaves)
    order = np.lexsort((leaves, rows))
    return rows[order], leaves[order]


def _earlier(homes: np.ndarray, leaf: int) -> np.ndarray:
    """Per row, packed bits of the leaves before ``leaf`` that it reaches; two rows met before if they share a bit."""
    owner, flat = np.repeat(np.arange(len(homes)), [len(x) for x in homes]), np.concatenate(homes)
    owner, flat = owner[flat < leaf], flat[flat < leaf]
    names, column = np.unique(flat, return_inverse=True)
    bits = np.zeros((len(homes), max(len(names), 1)), dtype=bool)
    bits[owner, column] = True
    return np.packbits(bits, axis=1)


def compare_leaf(leaf: int, dim: int, left: pd.DataFrame, right: pd.DataFrame | None, threshold: float) -> pd.DataFrame:
    """Links inside a block, or between two blocks, of one leaf: per vector its number of links and a smaller linked group.

    A pair counts only in the first leaf that it shares; links are reduced to a forest, pairs are never returned.
    """
    rows = left if right is None else pd.concat([left, right], ignore_index=True)
    order = np.argsort(rows["vid"].to_numpy(), kind="stable")
    ids, copies = rows["vid"].to_numpy()[order], rows["copies"].to_numpy()[order]
    side = np.concatenate([np.zeros(len(left), dtype=int), np.ones(len(rows) - len(left), dtype=int)])[order]
    vectors = np.stack(rows["vector"].to_numpy()[order]).astype(np.float64)
    before = _earlier(rows["leaves"].to_numpy()[order], leaf)
    norms = np.linalg.norm(vectors, axis=1)
    links, parent = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
    for start in range(0, len(ids), 1_024):
        stop = min(start + 1_024, len(ids))
        cosine = (vectors[start:stop] @ vectors[start:].T) / (norms[start:stop, None] * norms[None, start:])
        a, b = np.nonzero(cosine >= threshold)
        a, b = a + start, b + start
        wanted = (a < b) & ((side[a] != side[b]) if right is not None else True)
        a, b = a[wanted], b[wanted]
        new = np.ones(len(a), dtype=bool)
        for at in range(0, len(a), 100_000):
            part = slice(at, at + 100_000)
            new[part] = ~(before[a[part]] & before[b[part]]).any(axis=1)
        a, b = a[new], b[new]
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        parent = merge_links(parent, a, b)
    hit = np.flatnonzero(links)
    return pd.DataFrame({"vid": ids[hit], "links": links[hit], "up": ids[parent[hit]]})


def near_duplicates(df: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``df``.

    Links are pairs with a cosine (double precision) of at least ``threshold``. Vectors that are null, empty, zero or hold a null or a
    non-finite number link with nothing, and so do vectors of different lengths. Copies of one vector link with each other and are
    compared once. ``component_id`` is the smallest id reachable; a row without links is its own component. Rows that repeat an id
    and vector count as vectors of their own; a null id is never the smallest unless it is alone.
    """
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("vector"))
    sound = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    valid = rows.where(F.col("vector").isNotNull() & ~sound).where(norm > 0)
    kinds = valid.groupBy("vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    kinds = write_once(kinds.withColumn("vid", F.xxhash64("vector", F.lit(1))), "vectors")
    n_kinds = kinds.count()
    if not n_kinds:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    forest = share(df.sparkSession, "forest", fit_forest(kinds, threshold, n_kinds))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dim(batch):
                _, leaves = _route(_unit(_matrix(part.column("vector"), dim)), _trees(forest(), dim))
                leaf, n = np.unique(leaves, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), dim)), pa.array(leaf), pa.array(n)], names=["dim", "leaf", "n"])

    sizes = (
        kinds.select("vector").mapInArrow(counts, "dim long, leaf long, n long").groupBy("dim", "leaf").agg(F.sum("n").alias("n"))
    )
    # At most one leaf per NODE_SAMPLE rows of the bounded sample and tree can be over-full.
    full = {(r["dim"], r["leaf"]): -(-r["n"] // BLOCK_ROWS) for r in sizes.where(F.col("n") > BLOCK_ROWS).collect()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dim(batch):
                for start in range(0, part.num_rows, 512):
                    piece = part.slice(start, 512)
                    row, leaf = _route(_unit(_matrix(piece.column("vector"), dim)), _trees(forest(), dim))
                    bounds = np.searchsorted(row, np.arange(piece.num_rows + 1))
                    vid = piece.column("vid").to_numpy()
                    take, cell, one, two = [], [], [], []
                    for r, n in zip(row.tolist(), leaf.tolist(), strict=True):
                        blocks = full.get((dim, n), 1)
                        mine = int(vid[r] % blocks)
                        for other in range(blocks):
                            take.append(r)
                            cell.append(n)
                            one.append(min(mine, other))
                            two.append(max(mine, other))
                    homes = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(leaf))
                    index = pa.array(np.array(take, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(take), dim)), pa.array(cell, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                            pa.array((vid[take] % np.array([full.get((dim, n), 1) for n in cell])).astype(np.int64)),
                            *(piece.column(c).take(index) for c in ("vid", "copies", "vector")), homes.take(index),
                        ],
                        names=["dim", "leaf", "one", "two", "mine", "vid", "copies", "vector", "leaves"],
                    )

    kind = kinds.schema["vector"].dataType.simpleString()
    dealt = kinds.select("vid", "copies", "vector").mapInArrow(
        deal, f"dim long, leaf long, one long, two long, mine long, vid long, copies long, vector {kind}, leaves array<long>"
    )

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        dim, leaf, one, two = key
        if one == two:
            return compare_leaf(leaf, dim, rows, None, threshold)
        return compare_leaf(leaf, dim, rows[rows["mine"] == one], rows[rows["mine"] == two], threshold)

    found = dealt.groupBy("dim", "leaf", "one", "two").applyInPandas(compare, "vid long, links long, up long")
    found = write_once(found, "vector_links")
    parts = connected_components(found.select(F.col("vid").alias("u"), F.col("up").alias("v")))
    links = found.groupBy("vid").agg(F.sum("links").alias("links"))
    named = (
        kinds.select("vid", "vector", "copies", "first_id")
        .join(links, "vid", "left")
        .join(parts.withColumnRenamed("node", "vid"), "vid", "left")
        .withColumn("component", F.coalesce("component", "vid"))
    )
    named = write_once(named, "vector_parts")
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    # Only vectors with a link or a copy need a look-up.
    linked = named.where("links is not null or copies > 1").join(smallest, "component").select(
        F.col("vector").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    out = rows.join(linked, rows["vector"] == linked["_v"], "left")
    component = F.when(F.col("_v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = np.diff(batch.column("vector").offsets.to_numpy())
    for dim in np.unique(lengths).tolist():
        yield dim, batch.filter(pa.array(lengths == dim)) if (lengths != dim).any() else batch


def op2_projection_forest(spark, folder: str) -> DataFrame:
    """Links, component and survivors over all vectors."""
    return near_duplicates(table(spark, folder, "embeddings"))
