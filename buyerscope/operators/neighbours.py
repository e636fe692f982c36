"""k nearest neighbours between two tables, exact or by a chosen number of probes.

Base rows belong to the nearest of a set of pivot rows; these cells are put together to units of
bounded size. Every query row first searches the unit of its nearest pivot. The distance of the
k-th row found there is the limit of the second round: a row goes on only to units that can hold
a nearer one, by the radius of their cells and by the border between two cells. Neighbouring units stand
on shelves of up to ``SHELF_ROWS`` rows: a query row is sent once per shelf, with a bit for each unit that it
visits there, and brings back only rows within its limit. Units that are larger than a shelf are cut, and
crowds of query rows go in groups. Every base row that could matter is looked at.

In many dimensions (dozens) the bounds rule out little and exact search compares nearly all pairs. They are
compared by products in single precision with a bound of their error; what the bound cannot rule out is
measured again in double precision. ``probes`` is the caller's way out: only the nearest cells are searched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buyerscope.functions.expressions import hash_text
from buyerscope.storage import write_once

# Pivots are the square root of the base rows, up to this bound of what is sent to every task.
MAX_PIVOTS = 4096
BLOCK_ROWS = 1024
# Rows of a shelf, and of a group of query rows, are a twelfth of the table up to this bound of what a task holds.
SHELF_ROWS = 1 << 16
SPREAD = 12
# Rows whose distances to all pivots are held at a time.
PIECE_ROWS = 512
# Rounding of the distances must never exclude a true neighbour.
SLACK = 1e-7


def _distances(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """len(a) x len(b) distances, from differences (no cancellation), in bounded pieces."""
    out = np.empty((len(a), len(b)))
    piece = max(1, 2_000_000 // max(1, a.size))
    for start in range(0, len(b), piece):
        diff = a[:, None, :] - b[None, start : start + piece, :]
        d = np.abs(diff).sum(axis=2) if p == 1 else np.sqrt((diff * diff).sum(axis=2))
        out[:, start : start + piece] = d
    return out


def _squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared Euclidean distances in single precision by matrix products, and a bound of their error per row of ``a``."""
    with np.errstate(over="ignore", invalid="ignore"):
        centre = b.mean(axis=0)
        a, b = (a - centre).astype("float32"), (b - centre).astype("float32")
        size_a, size_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
        out = np.column_stack([-2 * a, size_a, np.ones_like(size_a)]) @ np.column_stack([b, np.ones_like(size_b), size_b]).T
        error = 8.0 * (a.shape[1] + 8) * 2.0**-24 * (size_a.astype("float64") + float(size_b.max(initial=0.0))) + 1e-30
    return out, error


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype="float64")


class Cells:
    """Pivots, the radius of each cell, and the units that cells are put together to."""

    def __init__(self, points: np.ndarray, p: int):
        self.points, self.p = points, p

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot of each row and the distance to it."""
        cell, r = np.zeros(len(x), dtype="int64"), np.zeros(len(x))
        for start in range(0, len(x), PIECE_ROWS):
            part = slice(start, start + PIECE_ROWS)
            d = _distances(x[part], self.points, self.p)
            cell[part] = d.argmin(axis=1)
            r[part] = d[np.arange(len(d)), cell[part]]
        return cell, r

    def close(self, sizes: dict[int, tuple[int, float]], unit_rows: int) -> dict[int, int]:
        """Keep the cells of ``sizes`` (rows, radius) and put neighbours together to about ``unit_rows`` rows; unit of each cell."""
        used = np.array(sorted(sizes))
        order = used[np.argsort(_distances(self.points[used[:1]], self.points[used], self.p)[0], kind="stable")]
        unit, held, units = 0, 0, []
        for c in order.tolist():
            if held and held + sizes[c][0] > unit_rows:
                unit, held = unit + 1, 0
            held += sizes[c][0]
            units.append(unit)
        self.points = self.points[order]
        self.radius = np.array([sizes[c][1] for c in order.tolist()])
        self.starts = np.unique(units, return_index=True)[1]
        return dict(zip(order.tolist(), units, strict=True))

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` units with the nearest pivots, per row."""
        out = []
        for start in range(0, len(x), PIECE_ROWS):
            d = np.minimum.reduceat(_distances(x[start : start + PIECE_ROWS], self.points, self.p), self.starts, axis=1)
            out.append(np.argsort(d, axis=1, kind="stable")[:, :n])
        return np.concatenate(out)

    def within(self, x: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """rows x units: whether the unit can hold a row at most ``limit`` away."""
        d = _distances(x, self.points, self.p)
        first = d.argmin(axis=1)
        least = d[np.arange(len(d)), first][:, None]
        # Rows of a cell are nearer to its pivot than to any other: they lie beyond the border to the query's cell.
        border = (d - least) / 2
        if self.p == 2:
            between = _distances(self.points[first], self.points, 2)
            far = between > 1e-6 * (d + least)
            border = np.where(far, (d - least) * (d + least) / (2 * np.where(far, between, 1.0)), border)
        bound = np.maximum(d - self.radius, border) - SLACK * (1 + d)
        return np.minimum.reduceat(bound, self.starts, axis=1) <= (limit * (1 + SLACK))[:, None]


def pick_pivots(base: DataFrame, n: int, seed: int = 42) -> np.ndarray:
    """``n`` base vectors in hash order: a fixed random choice, bounded by ``n`` rows."""
    rows = base.orderBy(hash_text("id", F.lit(seed)), "id").limit(n).select("v").collect()
    return np.unique(np.array([r["v"] for r in rows], dtype="float64"), axis=0)


def nearest_neighbours(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    p: int = 2,
    pivots: int | None = None,
    block_rows: int = BLOCK_ROWS,
    skip_same_id: bool = False,
    probes: int | None = None,
) -> DataFrame:
    """(query_id, rank, base_id, distance): the k nearest base rows of every query row.

    Both frames hold (id, v) with v an array of doubles. Equal distances are ordered by id.
    ``p`` is 1 (Manhattan) or 2 (Euclidean). ``skip_same_id`` leaves out the row itself when a
    table is compared with itself. The result is exact, unless ``probes`` limits the search to the
    cells of that many nearest pivots; a row may then miss neighbours, or find fewer than k.
    """
    if p not in (1, 2):
        raise ValueError("p must be 1 or 2")
    base = write_once(first_copies(base, k + 1 if skip_same_id else k), "neighbour_values")
    n_base = base.count()
    if not n_base:
        return _empty(queries, base)
    cells = Cells(pick_pivots(base, pivots or min(MAX_PIVOTS, math.isqrt(n_base))), p)
    types = queries.schema["id"].dataType.simpleString(), base.schema["id"].dataType.simpleString()

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, r = cells.place(_matrix(batch["v"]))
            yield batch.assign(cell=cell, r=r)

    placed = write_once(base.mapInPandas(assign, f"id {types[1]}, v array<double>, cell int, r double"), "neighbour_base")
    # One row per cell, MAX_PIVOTS at most.
    sizes = {r["cell"]: (r["n"], r["r"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("r")).collect()}
    unit_of = cells.close(sizes, block_rows if probes is None else 1)
    rows_of = [0] * (max(unit_of.values()) + 1)
    for c, unit in unit_of.items():
        rows_of[unit] += sizes[c][0]
    shelves = Shelves(rows_of, _side(n_base, block_rows))
    spark = base.sparkSession
    units = spark.createDataFrame([(c, u, shelves.first[u], shelves.blocks[u]) for c, u in unit_of.items()], "cell int, unit int, shelf int, blocks int")
    shelf = F.col("shelf") + F.pmod(F.xxhash64("id"), "blocks").cast("int")
    placed = placed.join(F.broadcast(units), "cell").select("id", "v", "unit", shelf.alias("shelf"))
    group_rows = _side(queries.count(), block_rows)

    def first_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), PIECE_ROWS):
                part = batch.iloc[start : start + PIECE_ROWS]
                found = cells.nearest(_matrix(part["v"]), probes or 1)
                reached = np.zeros((len(part), len(rows_of)), dtype=bool)
                reached[np.arange(len(part))[:, None], found] = True
                at, masks = shelves.visits(reached)
                yield pd.DataFrame({"query_id": part["id"], "q": part["v"], "nearest": found[:, 0], "reach": np.inf, "shelves": at, "masks": masks})

    def best(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return pd.DataFrame({"query_id": q["query_id"][:0], "base_id": b["id"][:0], "distance": np.zeros(0)})
        b = b.sort_values("id", kind="stable")
        found = _Best(q["query_id"].to_numpy(), _matrix(q["q"]), q["reach"].to_numpy(), b["id"].to_numpy(), _matrix(b["v"]), k, p, skip_same_id)
        visits = np.unpackbits(np.stack([np.frombuffer(m, dtype=np.uint8) for m in q["mask"]]), axis=1)
        place = b["unit"].to_numpy()
        begin = shelves.begins[int(q["shelf"].iloc[0])]
        for unit in np.unique(place).tolist():
            found.search(np.flatnonzero(visits[:, unit - begin]), np.flatnonzero(place == unit))
        return found.rows()

    def search(asked: DataFrame) -> DataFrame:
        """The k nearest per query row and shelf, within the row's reach. Each shelf meets each group of its visitors."""
        visits = asked.select("query_id", "q", "reach", F.inline(F.arrays_zip("shelves", "masks")).alias("shelf", "mask"))
        crowd = asked.select(F.explode("shelves").alias("shelf")).groupBy("shelf").agg(F.count("*").alias("n")).collect()
        plan = [(r["shelf"], math.ceil(r["n"] / group_rows)) for r in crowd]
        dealt = F.broadcast(spark.createDataFrame(plan, "shelf int, groups int"))
        left = visits.join(dealt, "shelf").select(
            "query_id", "q", "reach", "mask", "shelf", F.pmod(F.xxhash64("query_id"), "groups").cast("int").alias("grp")
        )
        right = placed.join(dealt, "shelf").select("id", "v", "unit", "shelf", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("grp"))
        return left.groupBy("shelf", "grp").cogroup(right.groupBy("shelf", "grp")).applyInPandas(
            best, f"query_id {types[0]}, base_id {types[1]}, distance double"
        )

    asked_type = f"query_id {types[0]}, q array<double>, nearest int, reach double, shelves array<int>, masks array<binary>"
    asked = write_once(queries.select("id", "v").mapInPandas(first_units, asked_type), "neighbour_first")
    near = write_once(_first_k(search(asked), k), "neighbour_near")
    if probes is not None:
        return near
    # The k-th distance found so far; a row with fewer neighbours has no limit.
    limits = near.where(F.col("rank") == k).select("query_id", F.col("distance").alias("limit"))

    def more_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), PIECE_ROWS):
                part = batch.iloc[start : start + PIECE_ROWS]
                part = part.assign(reach=part["limit"].fillna(np.inf))
                reached = cells.within(_matrix(part["q"]), part["reach"].to_numpy())
                reached[np.arange(len(part)), part["nearest"].to_numpy(dtype="int64")] = False
                at, masks = shelves.visits(reached)
                part = part.assign(shelves=at, masks=masks)
                yield part.loc[reached.any(axis=1), ["query_id", "q", "nearest", "reach", "shelves", "masks"]]

    again = write_once(asked.join(limits, "query_id", "left").mapInPandas(more_units, asked_type), "neighbour_second")
    return _first_k(near.drop("rank").unionByName(search(again)), k)


def _side(rows: int, block_rows: int) -> int:
    """Rows that a shelf, or a group of query rows, holds."""
    return min(max(SHELF_ROWS, block_rows), max(block_rows, math.ceil(rows / SPREAD)))


class Shelves:
    """Neighbouring units side by side, up to a number of rows; a larger unit is cut to several shelves of its own."""

    def __init__(self, rows_of: list[int], shelf_rows: int):
        self.first, self.blocks, self.begins, self.spans = [], [], [], []
        held = 0
        for unit, n in enumerate(rows_of):
            blocks = math.ceil(n / shelf_rows)
            if blocks > 1 or not self.begins or held + n > shelf_rows:
                self.spans.append((unit, unit + 1, range(len(self.begins), len(self.begins) + blocks)))
                self.begins += [unit] * blocks
                held = shelf_rows if blocks > 1 else n
            else:
                self.spans[-1] = (self.spans[-1][0], unit + 1, self.spans[-1][2])
                held += n
            self.first.append(self.spans[-1][2][0])
            self.blocks.append(blocks)

    def visits(self, reached: np.ndarray) -> tuple[list[list[int]], list[list[bytes]]]:
        """Shelves that each row visits, and the bits of its units there."""
        at: list[list[int]] = [[] for _ in reached]
        masks: list[list[bytes]] = [[] for _ in reached]
        for begin, end, shelves in self.spans:
            part = reached[:, begin:end]
            packed = np.packbits(part, axis=1)
            for i in np.flatnonzero(part.any(axis=1)).tolist():
                at[i] += shelves
                masks[i] += [packed[i].tobytes()] * len(shelves)
        return at, masks


class _Best:
    """The k nearest of the base rows searched so far, per query row and within its limit; base rows are in the order of their ids."""

    def __init__(self, names: np.ndarray, x: np.ndarray, limit: np.ndarray, ids: np.ndarray, base: np.ndarray, k: int, p: int, skip_same_id: bool):
        self.names, self.x, self.ids, self.base, self.k, self.p, self.skip = names, x, ids, base, k, p, skip_same_id
        # Rows with a null or an infinite number are at no finite distance from any.
        self.sound, self.base_sound = np.isfinite(x).all(axis=1), np.isfinite(base).all(axis=1)
        self.limit = limit.astype("float64")
        self.d, self.at = np.full((len(x), k), np.inf), np.full((len(x), k), -1, dtype="int64")

    def search(self, rows: np.ndarray, columns: np.ndarray) -> None:
        rows, columns = rows[self.sound[rows]], columns[self.base_sound[columns]]
        for start in range(0, len(columns), 2 * BLOCK_ROWS):
            some = columns[start : start + 2 * BLOCK_ROWS]
            for begin in range(0, len(rows), BLOCK_ROWS):
                self._block(rows[begin : begin + BLOCK_ROWS], some)

    def _block(self, rows: np.ndarray, columns: np.ndarray) -> None:
        x, base, limit = self.x[rows], self.base[columns], self.limit[rows]
        if self.p == 1:
            d, error, most = _distances(x, base, 1), np.zeros(len(x)), limit.copy()
        else:
            d, error = _squares(x, base)
            with np.errstate(over="ignore"):
                most = limit * limit * (1 + 1e-12) + error
        free, wanted = np.flatnonzero(np.isinf(limit)), self.k
        if len(free) and len(columns) > wanted:
            open_ = d[free]
            if self.skip:
                open_[self.names[rows[free]][:, None] == self.ids[columns][None, :]] = np.inf
            most[free] = np.partition(open_, wanted - 1, axis=1)[:, wanted - 1] + 2 * error[free]
        if self.p == 2:  # rounded up to single precision, so that the comparison stays in it
            with np.errstate(over="ignore"):
                most = np.nextafter(most.astype("float32"), np.float32(np.inf))
        # What is not a number stays in.
        i, j = np.divmod(np.flatnonzero(~(d > most[:, None])), len(columns))
        if self.skip:
            other = self.names[rows[i]] != self.ids[columns[j]]
            i, j = i[other], j[other]
        step = max(1, 2_000_000 // max(1, x.shape[1]))
        for start in range(0, len(i), step):
            a, b = i[start : start + step], j[start : start + step]
            if self.p == 1:
                exact = d[a, b]
            else:
                diff = x[a] - base[b]
                with np.errstate(over="ignore"):
                    exact = np.sqrt((diff * diff).sum(axis=1))
            near = np.isfinite(exact) & (exact <= self.limit[rows[a]])
            if near.any():
                self._take(rows[a[near]], columns[b[near]], exact[near])

    def _take(self, rows: np.ndarray, at: np.ndarray, d: np.ndarray) -> None:
        some, k = np.unique(rows), self.k
        r = np.concatenate([np.repeat(some, k), rows])
        d, at = np.concatenate([self.d[some].ravel(), d]), np.concatenate([self.at[some].ravel(), at])
        order = np.lexsort((at, d, r))
        r, d, at = r[order], d[order], at[order]
        starts = np.searchsorted(r, some)
        keep = np.arange(len(r)) - np.repeat(starts, np.diff(np.append(starts, len(r)))) < k
        self.d[some], self.at[some] = d[keep].reshape(-1, k), at[keep].reshape(-1, k)
        self.limit[some] = np.minimum(self.limit[some], self.d[some, k - 1])

    def rows(self) -> pd.DataFrame:
        row, rank = np.nonzero(np.isfinite(self.d))
        return pd.DataFrame({"query_id": self.names[row], "base_id": self.ids[self.at[row, rank]], "distance": self.d[row, rank]})


def _first_k(found: DataFrame, k: int) -> DataFrame:
    """Ranks 1..k per query row; a limit per group is applied before the shuffle."""
    nearest_first = Window.partitionBy("query_id").orderBy("distance", "base_id")
    ranked = found.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "base_id", "distance")


def first_copies(base: DataFrame, wanted: int) -> DataFrame:
    """(id, v) with only the ``wanted`` smallest ids of equal vectors.

    Equal vectors are equally far from every query row and ties go to the smaller id, so the
    other copies can never be among the nearest.
    """
    first = Window.partitionBy("v", "_part").orderBy("id")
    second = Window.partitionBy("v").orderBy("id")
    return (
        base.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(64)).alias("_part"))
        .withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") <= wanted)
        .withColumn("_n", F.row_number().over(second))
        .where(F.col("_n") <= wanted)
        .select("id", "v")
    )


def _empty(queries: DataFrame, base: DataFrame) -> DataFrame:
    layout = T.StructType(
        [
            T.StructField("query_id", queries.schema["id"].dataType),
            T.StructField("rank", T.IntegerType()),
            T.StructField("base_id", base.schema["id"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    return queries.sparkSession.createDataFrame([], layout)


def classify(
    queries: DataFrame, base: DataFrame, k: int = 5, weights: str = "uniform", p: int = 2, **options
) -> DataFrame:
    """(query_id, p, prediction): share of label 1 among the k nearest base rows.

    ``base`` also holds ``label``. ``weights='distance'`` weighs neighbours by 1 / distance; exact
    matches then decide alone.
    """
    pairs = nearest_neighbours(queries, base, k, p, **options)
    votes = pairs.join(base.select(F.col("id").alias("base_id"), "label"), "base_id")
    if weights == "uniform":
        weight = F.lit(1.0)
    elif weights == "distance":
        exact = F.min("distance").over(_per_query()) == 0
        weight = F.when(exact, (F.col("distance") == 0).cast("double")).otherwise(
            F.try_divide(F.lit(1.0), F.col("distance"))
        )
    else:
        raise ValueError(f"unknown weights: {weights}")
    scored = (
        votes.withColumn("w", weight)
        .groupBy("query_id")
        .agg((F.sum(F.col("w") * (F.col("label") == 1).cast("double")) / F.sum("w")).alias("p"))
    )
    return scored.withColumn("prediction", (F.col("p") > 0.5).cast("int"))


def _per_query() -> WindowSpec:
    return Window.partitionBy("query_id")
