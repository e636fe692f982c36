"""Boosted trees and forests on Spark: rows are binned once, many ensembles grow side by side.

``plan_of`` turns the familiar parameter names of each learner into a ``TreePlan``. Ensembles (a plan, and the fold that is left
out) grow in one of two ways with equal results:

* A table of at most ``BLOCK_ROWS`` rows and ``BLOCK_BYTES`` bytes of bins is dealt whole to every ensemble, one task each, so that a
  search over hundreds of candidates and folds is one job. It is dealt in packs of rows, bins feature by feature.
* A larger table stays where it is. One job per level adds up the sums of all nodes of all ensembles of a wave, partial sums first; the
  splits come back as one row per node. Margins are written once per round, so a lost executor costs one round.

Candidates that differ only in the number of rounds share one fit, and so do forests that differ in depth or in the size of a node that
may be split: the smaller one is read off the larger one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buyerscope.models import trees as T
from buyerscope.models.trees import Bins, Block, Ensemble, Growth, TreePlan
from buyerscope.operators.base import JsonModel
from buyerscope.storage import write_once

BLOCK_ROWS = 1 << 20  # rows of the largest table that one task may hold
BLOCK_BYTES = 1 << 26  # bytes of its bins, one per row and feature
WAVE = 16  # trees that grow side by side over a table that is not dealt whole
TREES = 3  # trees of a forest that one task grows, at least
TASKS = 96  # tasks that the trees of all forests are dealt to, at most about
NODES = 512  # nodes of one tree that one job sums up
PENDING = 8  # trees that wait until margins are written again
GATHERED = 1 << 16  # rows that are added up at a time
PACK = ["bins", "mark", "label", "fold", "margins"]
PACK_KINDS = ["u1", "<i8", "<f8", "<i4"]
PACKS = ", ".join(f"{c} binary" for c in PACK)
NO_FOLD = -1

# Names that mean the same, by the name that is used here.
_SAME = {"iterations": "n_estimators", "depth": "max_depth", "auto_class_weights": "class_weight"}
_CLASS_WEIGHTS = {None: "none", "balanced": "balanced", "Balanced": "balanced", "balanced_subsample": "subsample"}


def plan_of(kind: str, params: dict[str, Any], seed: int = 42) -> TreePlan:
    """The plan of a learner; a parameter that the learner does not have raises an error.

    Defaults are those of the libraries whose names the learners carry. No depth limit is None or a negative depth.
    """
    given = {_SAME.get(k, k): v for k, v in params.items()}
    if len(given) != len(params):
        raise ValueError(f"one parameter under two names: {sorted(params)}")

    def take(name: str, default: Any) -> Any:
        return given.pop(name, default)

    def depth(default: int | None) -> int | None:
        found = take("max_depth", default)
        return None if found is None or found < 0 else int(found)

    if kind in ("random_forest", "decision_tree"):
        mode = take("class_weight", None)
        forest = kind == "random_forest"
        if mode == "balanced_subsample" and not forest:
            raise ValueError("a single tree has no sample of its own")
        plan = TreePlan(
            boosted=False, rounds=int(take("n_estimators", 100)) if forest else 1, rate=1.0, depth=depth(None),
            criterion=take("criterion", "gini"), min_split=int(take("min_samples_split", 2)), min_rows=int(take("min_samples_leaf", 1)),
            bootstrap="poisson" if forest else "none", node_features="sqrt" if forest else "all", weights=_CLASS_WEIGHTS[mode], seed=seed,
        )
        if plan.criterion not in ("gini", "entropy"):
            raise ValueError(f"unknown criterion {plan.criterion}")
    else:
        positive = take("scale_pos_weight", None)
        weights = _CLASS_WEIGHTS[take("class_weight", None)]
        if positive is not None:
            weights = "positive" if positive == "balanced" else str(float(positive))
        common = {"weights": weights, "seed": seed, "rounds": int(take("n_estimators", 100))}
        share = float(take("subsample", 1.0)) if kind != "catboost" else 1.0
        common |= {"row_share": share, "bootstrap": "share" if share < 1 else "none"}
        if kind == "gradient_boosting":
            plan = TreePlan(**common, rate=take("learning_rate", 0.1), depth=depth(3), criterion="residual", prior=True,
                            min_split=int(take("min_samples_split", 2)))
        elif kind == "xgboost":
            plan = TreePlan(**common, rate=take("learning_rate", 0.3), depth=depth(6), l1=take("reg_alpha", 0.0), l2=take("reg_lambda", 1.0),
                            min_gain=take("gamma", 0.0), min_hessian=take("min_child_weight", 1), feature_share=take("colsample_bytree", 1.0))
        elif kind == "lightgbm":
            plan = TreePlan(**common, rate=take("learning_rate", 0.1), depth=depth(None), leaves=int(take("num_leaves", 31)), grow="best",
                            l1=take("reg_alpha", 0.0), l2=take("reg_lambda", 0.0), min_rows=int(take("min_child_samples", 20)),
                            min_hessian=take("min_child_weight", 1e-3), min_gain=take("min_split_gain", 0.0),
                            feature_share=take("colsample_bytree", 1.0), prior=True)
        elif kind == "catboost":
            plan = _catboost(common, depth(6), take)
        else:
            raise ValueError(f"unknown learner: {kind}")
    if given:
        raise ValueError(f"{kind} has no parameters {sorted(given)}")
    return plan


def _catboost(common: dict, depth: int | None, take) -> TreePlan:
    kind = take("bootstrap_type", "MVS")
    if kind not in ("Bayesian", "Bernoulli", "MVS", "No"):
        raise ValueError(f"unknown bootstrap_type {kind}")
    if kind == "Bayesian":
        common |= {"bootstrap": "bayesian", "temperature": float(take("bagging_temperature", 1.0))}
    elif kind == "Bernoulli":
        common |= {"bootstrap": "share", "row_share": float(take("subsample", 0.8))}
    elif kind == "MVS":
        common |= {"bootstrap": "mvs", "row_share": float(take("subsample", 0.8))}
    return TreePlan(**common, rate=take("learning_rate", 0.1), depth=6 if depth is None else depth, l2=take("l2_leaf_reg", 3.0), grow="oblivious")


# --- rows ---------------------------------------------------------------------------------------


@dataclass
class Binned:
    """Binned rows ``key, mark, label, fold, bins`` in the shared folder, and what the ensembles need to know of them."""

    bins: Bins
    rows: DataFrame
    counts: dict[tuple[int, int], int]  # (fold, label) -> rows
    chosen: tuple[int, ...] | None = None  # features of the rows that are read; None: all
    width: int | None = None  # bytes of a row's bins

    def only(self, features: Sequence[int]) -> Binned:
        """The same rows with some of the features."""
        return replace(self, bins=Bins([self.bins.edges[j] for j in features]), chosen=tuple(features), width=len(self.bins.edges))

    @property
    def reading(self) -> Callable[[np.ndarray], np.ndarray]:
        """From the bytes of some rows to their bins, a row each."""
        width, chosen = max(self.width or len(self.bins.edges), 1), self.chosen

        def read(data: np.ndarray) -> np.ndarray:
            found = data.reshape(-1, width)
            return found if chosen is None else found[:, list(chosen)]

        return read

    @property
    def n_rows(self) -> int:
        return sum(self.counts.values())

    def fits(self, block_rows: int | None = None) -> bool:
        """Whether one task may hold all rows."""
        if block_rows is not None:
            return self.n_rows <= block_rows
        return self.n_rows <= BLOCK_ROWS and self.n_rows * len(self.bins.edges) <= BLOCK_BYTES

    def packs(self, keys: bool = True) -> DataFrame:
        """The rows in packs of about ``GATHERED``, bins feature by feature."""
        reading, kind = self.reading, self.rows.schema["key"].dataType.simpleString()

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _gathered(batches):
                data = np.frombuffer(b"".join(rows.column("bins").to_pylist()), dtype=np.uint8)
                parts = [np.ascontiguousarray(reading(data).T), *(rows.column(c).to_numpy() for c in PACK[1:4])]
                cells = [pa.array([x.astype(k).tobytes()], pa.binary()) for x, k in zip(parts, PACK_KINDS, strict=True)]
                if keys:
                    own = rows.column("key")
                    cells.append(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own))
                yield pa.RecordBatch.from_arrays(cells, names=PACK[:4] + ["key"] * keys)

        schema = ", ".join(f"{c} binary" for c in PACK[:4]) + f", key array<{kind}>" * keys
        return (self.rows if keys else self.rows.drop("key")).mapInArrow(pack, schema)

    def classes(self, plan: TreePlan, fold: int) -> tuple[float, float]:
        """Weights of class 0 and 1 among the rows outside ``fold``."""
        no, yes = (sum(n for (f, y), n in self.counts.items() if y == c and f != fold) for c in (0, 1))
        if plan.weights == "balanced":
            return (no + yes) / (2 * no) if no else 1.0, (no + yes) / (2 * yes) if yes else 1.0
        if plan.weights == "positive":
            return 1.0, no / max(yes, 1)
        return (1.0, 1.0) if plan.weights in ("none", "subsample") else (1.0, float(plan.weights))

    def start(self, plan: TreePlan, fold: int) -> float:
        """Margin that boosting starts from: the log-odds of the weighted classes, if the plan asks for it."""
        if not plan.prior:
            return 0.0
        no, yes = (sum(n for (f, y), n in self.counts.items() if y == c and f != fold) * w for c, w in enumerate(self.classes(plan, fold)))
        return float(np.log(yes / no)) if no and yes else 0.0


def bin_rows(df: DataFrame, features: str = "features", label: str = "label", key: str | None = "key", fold: str | None = None) -> Binned:
    """Cut the feature vectors to bins at quantiles of all rows of ``df``; labels play no part in it.

    ``key`` decides each row's random draws (without one its features do).
    """
    x = vector_to_array(F.col(features))
    size = df.select(F.size(x).alias("n")).agg(F.max("n")).first()[0] or 0
    columns = [F.get(x, F.lit(j)).alias(f"x{j}") for j in range(size)]
    steps = [i / T.MAX_BINS for i in range(T.MAX_BINS + 1)]
    found = df.select(*columns).approxQuantile([f"x{j}" for j in range(size)], steps, 1e-3) if size else []
    bins = Bins([sorted(set(q))[:-1] for q in found])
    mark = F.xxhash64(F.col(key)) if key and key in df.columns else F.xxhash64(x)
    own = F.col(key) if key and key in df.columns else mark
    rows = df.select(own.alias("key"), mark.alias("mark"), F.col(label).cast("double").alias("label"),
                     (F.col(fold).cast("int") if fold else F.lit(0)).alias("fold"), x.alias("x"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(max(size, 1)), batch.num_rows, [None, pa.py_buffer(bins.cut(values).tobytes() or b"\0" * batch.num_rows)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], packed.cast(pa.binary())], names=["key", "mark", "label", "fold", "bins"])

    kind = rows.schema["key"].dataType.simpleString()
    table = write_once(rows.mapInArrow(cut, f"key {kind}, mark long, label double, fold int, bins binary"), "binned")
    counts = {(r["fold"], int(r["label"])): r["n"] for r in table.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
    return Binned(bins, table, counts)


def _block(batches: Sequence[pa.RecordBatch], reading: Callable[[np.ndarray], np.ndarray] | int) -> Block:
    rows = pa.Table.from_batches(batches)
    data = np.frombuffer(b"".join(rows.column("bins").to_pylist()), dtype=np.uint8)
    bins = data.reshape(rows.num_rows, reading) if isinstance(reading, int) else reading(data)
    order = np.argsort(rows.column("mark").to_numpy(), kind="stable")
    key = rows.column("key").combine_chunks() if "key" in rows.column_names else None
    marks = rows.column("mark").to_numpy().view(np.uint64)
    return Block(bins, rows.column("label").to_numpy(), rows.column("fold").to_numpy(), marks, key).take(order)


def _unpacked(batches: Sequence[pa.RecordBatch], width: int) -> Block:
    """One block of all packs, in the order of the marks."""
    found: list[list[np.ndarray]] = [[], [], [], []]
    for batch in batches:
        for own, name, kind in zip(found, PACK, PACK_KINDS, strict=False):
            own += [np.frombuffer(cell.as_buffer(), dtype=kind) for cell in batch.column(name)]
    bins = np.concatenate([x.reshape(width, len(y)) for x, y in zip(found[0], found[2], strict=True)], axis=1)
    mark, label, fold = (np.concatenate(x) for x in found[1:])
    keys = [batch.column("key").flatten() for batch in batches if "key" in batch.schema.names]
    return Block(bins.T, label, fold, mark.view(np.uint64), pa.concat_arrays(keys) if keys else None).take(np.argsort(mark, kind="stable"))


# --- ensembles ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Reading:
    """A smaller ensemble inside a larger one: its first trees, cut at a depth and at small nodes."""

    candidate: int
    rounds: int
    depth: int | None = None
    min_split: int = 0


@dataclass(frozen=True)
class Trial:
    """An ensemble to grow on all rows outside ``fold``, and the readings to take of it."""

    plan: TreePlan
    fold: int = NO_FOLD
    readings: tuple[Reading, ...] = ()

    @property
    def cost(self) -> float:
        return self.plan.rounds * (self.plan.depth or 12)


def grow(
    bins: Bins, block: Block, plan: TreePlan, classes: tuple[float, float], start: float, numbers: range | None = None, known: Sequence[T.Tree] = ()
) -> Ensemble:
    """Grow an ensemble, or some trees of a forest, on the rows of one block; a boosted one may go on from trees that are ``known``."""
    out, margin, columns = Ensemble(plan.boosted, start), np.full(len(block.label), start), block.columns.T
    for tree in known:
        out.trees.append(tree)
        margin += tree.scores(columns)
    for number in range(len(known), plan.rounds) if numbers is None else numbers:
        cut = None
        if plan.bootstrap == "mvs":
            cut = T.mvs_threshold(T.size_counts(block, margin, plan, classes), plan.row_share)
        sample = T.gradients(block, margin, plan, number, classes, cut)
        tree, scores = T.grow_tree(bins, block, sample, Growth(plan, number, len(bins.edges), classes))
        out.trees.append(tree)
        if plan.boosted:
            margin[sample[0]] += scores
            if len(scores) < len(margin):
                rest = np.ones(len(margin), dtype=bool)
                rest[sample[0]] = False
                rest = np.flatnonzero(rest)
                margin[rest] += tree.scores(columns, some=rest)
    return out


def read_off(ensemble: Ensemble, rows: np.ndarray, readings: Sequence[Reading]) -> dict[int, np.ndarray]:
    """Scores of every reading, by candidate."""
    out = {}
    for limits in {(r.depth, r.min_split) for r in readings}:
        same = sorted((r for r in readings if (r.depth, r.min_split) == limits), key=lambda r: r.rounds)
        total, done = np.zeros(len(rows)), 0
        for r in same:
            for tree in ensemble.trees[done : r.rounds]:
                total = total + tree.scores(rows, depth=limits[0], min_split=limits[1])
            done = r.rounds
            out[r.candidate] = T.sigmoid(ensemble.start + total) if ensemble.boosted else total / r.rounds
    return out


def fit_ensembles(table: Binned, trials: Sequence[Trial], block_rows: int | None = None) -> list[Ensemble]:
    """The grown ensembles, in the order of ``trials``."""
    if not table.fits(block_rows):
        return _grow_by_level(table, trials)
    return [Ensemble.unpack(one) for one in _packed_ensembles(table, trials)]


def _packed_ensembles(table: Binned, trials: Sequence[Trial]) -> list[dict[str, Any]]:
    """The ensembles as they come from the tasks, forests in parts: a deep forest on many rows is never unpacked on the driver."""

    def pack(part: int, ensemble: Ensemble, block: Block) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([json.dumps(ensemble.pack())])], names=["part", "packed"])

    parts = _parts(trials)
    found = {r["part"]: json.loads(r["packed"]) for r in _each_trial(table, trials, pack, "part long, packed string", parts).collect()}
    own = [[found[k] for k, (i, _) in enumerate(parts) if i == trial] for trial in range(len(trials))]
    return [one[0] if len(one) == 1 else {"parts": one} for one in own]


def _parts(trials: Sequence[Trial]) -> list[tuple[int, range | None]]:
    """What one task grows: a boosted ensemble, or some trees of a forest, which do not wait for each other."""
    total = sum(t.plan.rounds for t in trials if not t.plan.boosted)
    step = max(TREES, -(-total // TASKS))
    out: list[tuple[int, range | None]] = []
    for i, t in enumerate(trials):
        out += [(i, None)] if t.plan.boosted else [(i, range(a, min(a + step, t.plan.rounds))) for a in range(0, t.plan.rounds, step)]
    return out


def held_out_scores(table: Binned, trials: Sequence[Trial], block_rows: int | None = None, grown: Sequence[Ensemble] | None = None) -> DataFrame:
    """(candidate, fold, key, label, p) of the rows in each trial's fold, for all readings of all trials, which may have ``grown`` before."""
    kind = table.rows.schema["key"].dataType.simpleString()
    schema, names = f"candidate int, fold int, key {kind}, label double, p double", ["candidate", "fold", "key", "label", "p"]

    def score(trial: int, ensemble: Ensemble, block: Block) -> Iterator[pa.RecordBatch]:
        fold = trials[trial].fold
        part = block.take(np.flatnonzero(block.fold == fold))
        for candidate, p in read_off(ensemble, part.bins, trials[trial].readings).items():
            n = len(p)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, candidate, dtype=np.int32)), pa.array(np.full(n, fold, dtype=np.int32)), part.key, pa.array(part.label), pa.array(p)], names=names
            )

    if grown is None and table.fits(block_rows):
        forests = [i for i, t in enumerate(trials) if not t.plan.boosted and t.plan.rounds > TREES]
        rest = [i for i in range(len(trials)) if i not in set(forests)]
        out = []
        if forests:
            out.append(_forest_scores(table, [trials[i] for i in forests], lambda i, ensemble, block: score(forests[i], ensemble, block), schema))
        if rest:
            out.append(_each_trial(table, [trials[i] for i in rest], lambda i, ensemble, block: score(rest[i], ensemble, block), schema))
        return reduce(DataFrame.unionByName, out)
    packed = table.rows.sparkSession.sparkContext.broadcast(cloudpickle.dumps(_grow_by_level(table, trials) if grown is None else grown))
    reading = table.reading

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ensembles = cloudpickle.loads(packed.value)
        for batch in (b for b in batches if b.num_rows):
            block = _block([batch], reading)
            for number, ensemble in enumerate(ensembles):
                yield from score(number, ensemble, block)

    return table.rows.mapInArrow(apply, schema)


def _forest_scores(table: Binned, trials: Sequence[Trial], use, schema: str) -> DataFrame:
    """Forests over a small table: their trees grow in many tasks and are written once, then one task per forest reads its trees and the rows of its fold."""

    def pack(part: int, ensemble: Ensemble, block: Block) -> Iterator[pa.RecordBatch]:
        trial, numbers = parts[part]
        cells = [pa.array([x], pa.int32()) for x in (trial, numbers.start)]
        yield pa.RecordBatch.from_arrays([*cells, pa.array([json.dumps(ensemble.pack(fields))])], names=["slot", "place", "packed"])

    parts, reading = _parts(trials), table.reading
    limited = any(r.depth is not None or r.min_split for t in trials for r in t.readings)
    fields = (*T.Tree.SCORING, "rows", "depth") if limited else T.Tree.SCORING
    grown = write_once(_each_trial(table, trials, pack, "slot int, place int, packed string", parts), "grown")
    folds = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(t.fold).alias("own")) for i, t in enumerate(trials)])
    rows = table.rows.select("*", F.inline(folds)).where("fold = own").drop("own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, held, trial = [], [], None
        for batch in (b for b in batches if b.num_rows):
            trial = batch.column("slot")[0].as_py()
            packed = batch.column("packed").is_valid()
            for at, text in zip(batch.column("place").filter(packed).to_pylist(), batch.column("packed").filter(packed).to_pylist(), strict=True):
                trees.append((at, Ensemble.unpack(json.loads(text), fields)))
            held.append(batch.filter(pa.compute.invert(packed)))
        if sum(b.num_rows for b in held):
            trees.sort(key=lambda x: x[0])
            whole = replace(trees[0][1], trees=[tree for _, some in trees for tree in some.trees])
            yield from use(trial, whole, _block(held, reading))

    both = rows.unionByName(grown, allowMissingColumns=True).repartitionById(len(trials), F.col("slot"))
    return both.mapInArrow(run, schema)


def grown_scores(table: Binned, trials: Sequence[Trial], earlier: tuple[DataFrame, Sequence[Trial]] | None = None) -> DataFrame:
    """``held_out_scores`` of boosted ensembles over a table that one task may hold, and for each a row (place, packed) of its trees.

    ``earlier`` holds such rows of ensembles with fewer rounds, and their trials: those that differ in rounds only are carried on.
    """
    kind = table.rows.schema["key"].dataType.simpleString()
    names = ["candidate", "fold", "key", "label", "p"]
    types = [pa.int32(), pa.int32(), None, pa.float64(), pa.float64()]

    def score(trial: int, ensemble: Ensemble, block: Block) -> Iterator[pa.RecordBatch]:
        fold = trials[trial].fold
        part = block.take(np.flatnonzero(block.fold == fold))
        for candidate, p in read_off(ensemble, part.bins, trials[trial].readings).items():
            n = len(p)
            cells = [pa.array(np.full(n, candidate, dtype=np.int32)), pa.array(np.full(n, fold, dtype=np.int32)), part.key, pa.array(part.label), pa.array(p)]
            yield pa.RecordBatch.from_arrays([*cells, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names=[*names, "place", "packed"])
        cells = [pa.nulls(1, part.key.type if t is None else t) for t in types]
        packed = json.dumps(ensemble.pack(T.Tree.SCORING))
        yield pa.RecordBatch.from_arrays([*cells, pa.array([trial], pa.int32()), pa.array([packed])], names=[*names, "place", "packed"])

    begun = None
    if earlier is not None:
        before = {(replace(t.plan, rounds=0), t.fold): i for i, t in enumerate(earlier[1])}
        same = [before.get((replace(t.plan, rounds=0), t.fold)) for t in trials]
        pairs = F.array(*[F.struct(F.lit(i).alias("trial"), F.lit(s).alias("own")) for i, s in enumerate(same) if s is not None])
        begun = earlier[0].select("*", F.inline(pairs)).where("place = own").select("trial", "packed") if any(s is not None for s in same) else None
    return _each_trial(table, trials, score, f"candidate int, fold int, key {kind}, label double, p double, place int, packed string", begun=begun)


def _each_trial(
    table: Binned, trials: Sequence[Trial], use, schema: str, parts: Sequence[tuple[int, range | None]] | None = None, begun: DataFrame | None = None
) -> DataFrame:
    """Deal the rows of a small table to one task per trial, or per part of one (without the keys), the longest first, and ``use`` what each of them grows.

    ``begun`` holds (trial, packed): the first trees of boosted trials.
    """
    bins, width, keys, carried = table.bins, len(table.bins.edges), parts is None, begun is not None
    parts = [(i, None) for i in range(len(trials))] if parts is None else parts
    order = sorted(range(len(parts)), key=lambda k: -trials[parts[k][0]].cost)
    known = [(table.classes(t.plan, t.fold), table.start(t.plan, t.fold)) for t in trials]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        part = order[held[0].column("slot")[0].as_py()]
        trial, numbers = parts[part]
        first = [text for b in held if carried for text in b.column("packed").drop_null().to_pylist()]
        if first:
            held = [b.filter(b.column("packed").is_null()) for b in held]
        block = _unpacked(held, width)
        held.clear()
        inside = block.take(np.flatnonzero(block.fold != trials[trial].fold))
        trees = [tree for text in first for tree in Ensemble.unpack(json.loads(text), T.Tree.SCORING).trees]
        yield from use(part, grow(bins, inside, trials[trial].plan, *known[trial], numbers, trees), block)

    slots = F.explode(F.sequence(F.lit(0), F.lit(len(parts) - 1))).alias("slot")
    dealt = table.packs(keys).select(slots, "*")
    if carried:
        places = F.array(*[F.lit(order.index(i)) for i in range(len(trials))])
        dealt = dealt.unionByName(begun.select(F.get(places, F.col("trial")).alias("slot"), "packed"), allowMissingColumns=True)
    return dealt.repartitionById(len(parts), F.col("slot")).mapInArrow(run, schema)


# --- tables that stay where they are ---------------------------------------------------------------


def _grow_by_level(table: Binned, trials: Sequence[Trial]) -> list[Ensemble]:
    out: list[Ensemble | None] = [None] * len(trials)
    for boosted in (True, False):
        some = [i for i, t in enumerate(trials) if t.plan.boosted == boosted]
        for start in range(0, len(some), WAVE):
            wave = some[start : start + WAVE]
            found = _Wave(table, [trials[i] for i in wave]).grow()
            for i, ensemble in zip(wave, found, strict=True):
                out[i] = ensemble
    return out


class _Wave:
    """Ensembles that grow side by side over all rows, one Spark job for a level of them all."""

    def __init__(self, table: Binned, trials: Sequence[Trial]):
        self.table, self.trials, self.n_features = table, trials, len(table.bins.edges)
        self.classes = [table.classes(t.plan, t.fold) for t in trials]
        self.out = [Ensemble(t.plan.boosted, table.start(t.plan, t.fold)) for t in trials]
        self.state = self._packed()
        self.pending: list[tuple[int, T.Tree]] = []  # trees that the written margins do not hold yet
        self.every = max(1, PENDING // len(trials))  # rounds between two writings

    def _packed(self) -> DataFrame:
        """The rows in packs; margins are empty until trees are added."""
        return write_once(self.table.packs(keys=False).withColumn("margins", F.lit(b"")), "packed")

    def grow(self) -> list[Ensemble]:
        boosted = self.trials[0].plan.boosted
        for number in range(max(t.plan.rounds for t in self.trials)) if boosted else ():
            self._round([(i, number) for i, t in enumerate(self.trials) if number < t.plan.rounds])
        lanes = [] if boosted else [(i, k) for i, t in enumerate(self.trials) for k in range(t.plan.rounds)]
        for start in range(0, len(lanes), WAVE):  # trees of a forest do not wait for each other
            self._round(lanes[start : start + WAVE])
        return self.out

    def _round(self, lanes: list[tuple[int, int]]) -> None:
        cuts = self._thresholds(lanes)
        trees = [Growth(self.trials[i].plan, number, self.n_features, self.classes[i]) for i, number in lanes]
        while any(not t.done for t in trees):
            found: dict[int, list] = {k: [] for k, t in enumerate(trees) if not t.done}
            for part in range(-(-max(len(trees[k].wanted) for k in found) // NODES)):
                asked = []
                for k in found:
                    plan = self.trials[lanes[k][0]].plan
                    # One split for a whole level needs the sums of the whole level.
                    wanted = trees[k].wanted if plan.grow == "oblivious" else trees[k].wanted[part * NODES : (part + 1) * NODES]
                    if wanted and (part == 0 or plan.grow != "oblivious"):
                        asked.append((k, trees[k].partial(), wanted, [trees[k].path[n] for n in wanted], trees[k].features, trees[k].classes))
                for k, splits in self._splits(lanes, cuts, asked):
                    found[k] += splits
            for k, splits in found.items():
                trees[k].take(splits)
        grown = [t.finish() for t in trees]
        for (i, _), tree in zip(lanes, grown, strict=True):
            self.out[i].trees.append(tree)
        if self.trials[0].plan.boosted:
            self.pending += [(i, tree) for (i, _), tree in zip(lanes, grown, strict=True)]
            done = lanes[0][1] + 1
            if done % self.every == 0 and done < max(t.plan.rounds for t in self.trials):
                self._write()

    def _thresholds(self, lanes: list[tuple[int, int]]) -> dict[int, float]:
        """Thresholds of the mvs bootstrap, by trial."""
        plans, classes, read = {i: self.trials[i] for i, _ in lanes if self.trials[i].plan.bootstrap == "mvs"}, self.classes, self._reader()
        if not plans:
            return {}

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, margins in read(batches):
                for i, t in plans.items():
                    on = np.flatnonzero(block.fold != t.fold)
                    part = Block(block.bins[:0], block.label[on], block.fold[on], block.mark[on])
                    sizes = T.size_counts(part, margins[i][on], t.plan, classes[i])
                    hit = np.flatnonzero(sizes[:, 0])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(hit), i)), pa.array(hit), pa.array(sizes[hit, 0]), pa.array(sizes[hit, 1])], names=["trial", "bin", "n", "s"]
                    )

        rows = self.state.mapInArrow(count, "trial long, bin long, n double, s double").groupBy("trial", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        counts = {i: np.zeros((T.MVS_BINS, 2)) for i in plans}
        for r in rows.collect():  # 256 rows a trial
            counts[r["trial"]][r["bin"]] = r["n"], r["s"]
        return {i: T.mvs_threshold(c, plans[i].plan.row_share) for i, c in counts.items()}

    def _splits(self, lanes, cuts: dict[int, float], asked: list[tuple]) -> Iterator[tuple[int, list]]:
        """Best splits of the asked nodes: sums per task, added up by lane, one small row per lane back."""
        bins, classes, read = self.table.bins, self.classes, self._reader()
        plans, folds = [t.plan for t in self.trials], [t.fold for t in self.trials]
        context = self.state.sparkSession.sparkContext
        packed = context.broadcast(cloudpickle.dumps(asked))

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            work = cloudpickle.loads(packed.value)
            sums = {k: np.zeros((3, len(wanted), bins.total)) for k, _, wanted, *_ in work}
            for block, margins in read(batches):
                for k, tree, wanted, _, features, _ in work:
                    i, number = lanes[k]
                    rows, *weights = T.gradients(block, margins[i], plans[i], number, classes[i], cuts.get(i))
                    if folds[i] != NO_FOLD:
                        on = np.flatnonzero(block.fold[rows] != folds[i])
                        g, h, n = weights
                        rows, weights = rows[on], [g[on], h[on]]
                        weights.append(weights[1] if n is h else n[on])
                    sums[k] += T.node_sums(bins, block, (rows, *weights), tree.places(block.bins), wanted, features)
            for k, s in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([s.tobytes()], pa.binary())], names=["lane", "sums"])

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            work = {k: rest for k, *rest in cloudpickle.loads(packed.value)}
            lane, total = None, None

            def best() -> pa.RecordBatch:
                _, _, paths, features, own = work[lane]
                i, number = lanes[lane]
                splits = T.best_splits(bins, total.reshape(3, -1, bins.total), paths, plans[i], own, features, number)
                return pa.RecordBatch.from_arrays([pa.array([lane]), pa.array([json.dumps(splits)])], names=["lane", "splits"])

            for batch in batches:
                for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if k != lane:
                        if lane is not None:
                            yield best()
                        lane, total = k, np.zeros(len(s) // 8)
                    total += np.frombuffer(s, dtype=np.float64)
            if lane is not None:
                yield best()

        parts = self.state.mapInArrow(add_up, "lane long, sums binary").repartition("lane").sortWithinPartitions("lane")
        for r in parts.mapInArrow(choose, "lane long, splits string").collect():
            yield r["lane"], [tuple(x) for x in json.loads(r["splits"])]
        packed.unpersist()

    def _write(self) -> None:
        """Write the margins with all trees so far."""
        read = self._reader()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    one = batch.slice(i, 1)
                    ((_, margins),) = read([one])
                    yield pa.RecordBatch.from_arrays([*one.columns[:4], pa.array([margins.tobytes()], pa.binary())], names=PACK)

        self.state = write_once(self.state.mapInArrow(add, PACKS), "margins")
        self.pending = []

    def _reader(self) -> Callable[[Iterable[pa.RecordBatch]], Iterator[tuple[Block, np.ndarray]]]:
        """From packs to blocks with the margins of all trees so far, (ensembles, rows)."""
        packed, starts, width = cloudpickle.dumps(self.pending), [e.start for e in self.out], self.n_features

        def read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Block, np.ndarray]]:
            pending = cloudpickle.loads(packed)
            for batch in batches:
                for row in range(batch.num_rows):
                    bins, mark, label, fold, before = (batch.column(c)[row].as_buffer() for c in PACK)
                    label = np.frombuffer(label, dtype="<f8")
                    columns = np.frombuffer(bins, dtype=np.uint8).reshape(width, len(label))
                    block = Block(columns.T, label, np.frombuffer(fold, dtype="<i4"), np.frombuffer(mark, dtype="<u8"))
                    if before.size:
                        margins = np.frombuffer(before, dtype="<f8").reshape(len(starts), len(label)).copy()
                    else:
                        margins = np.repeat(np.array(starts, dtype=np.float64)[:, None], len(label), axis=1)
                    for i, tree in pending:
                        margins[i] += tree.scores(block.bins)
                    yield block, margins

        return read


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``GATHERED``: sums by node and bin cost the same for few rows as for many."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= GATHERED:
            yield _joined(held)
            held = []
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


# --- searches -----------------------------------------------------------------------------------


def families(plans: Sequence[TreePlan], folds: Sequence[int]) -> list[Trial]:
    """One trial per fold for all plans that can be read off one ensemble; candidates are numbered by their place in ``plans``."""
    groups: dict[TreePlan, list[int]] = {}
    for i, plan in enumerate(plans):
        same = replace(plan, rounds=0) if plan.boosted else replace(plan, rounds=0, depth=None, min_split=0)
        groups.setdefault(same, []).append(i)
    out = []
    for same, members in groups.items():
        rounds = max(plans[i].rounds for i in members)
        if same.boosted:
            whole = replace(same, rounds=rounds)
            readings = tuple(Reading(i, plans[i].rounds) for i in members)
        else:
            depths = [plans[i].depth for i in members]
            whole = replace(same, rounds=rounds, depth=None if None in depths else max(depths), min_split=min(plans[i].min_split for i in members))
            readings = tuple(Reading(i, plans[i].rounds, plans[i].depth, plans[i].min_split) for i in members)
        out += [Trial(whole, f, readings) for f in folds]
    return out


# --- the fitted stage -----------------------------------------------------------------------------


class TreesModel(JsonModel):
    """A grown ensemble as a pipeline stage."""

    DEFAULTS = {"features": "features", "name": "model"}

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - the name that Spark's own tree models use
        state = self.state()
        return DenseVector(Ensemble.unpack(state["ensemble"], ("feature", "gain")).gains(len(state["edges"])))

    def ensemble(self) -> tuple[Bins, Ensemble]:
        state = self.state()
        return Bins(state["edges"]), Ensemble.unpack(state["ensemble"])

    def scoring(self) -> dict[str, Any]:
        """What tasks need to score rows, packed as it is."""
        state = self.state()
        whole = state["ensemble"]
        read = ("boosted", "start", "sizes", *T.Tree.SCORING)
        return {"edges": state["edges"], "ensemble": {"parts": [{f: one[f] for f in read} for one in whole.get("parts", [whole])]}}

    def _transform(self, df: DataFrame) -> DataFrame:
        name = self.opt("name")
        packed = df.sparkSession.sparkContext.broadcast(self.scoring())

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            cutter, found = Bins(packed.value["edges"]), Ensemble.unpack(packed.value["ensemble"], T.Tree.SCORING)
            for batch in batches:
                x = np.array(batch.tolist(), dtype=np.float64).reshape(len(batch), len(cutter.edges))
                yield pd.Series(found.probabilities(cutter.cut(x)))

        p = score(vector_to_array(F.col(self.opt("features"))))
        scored = df.withColumn(f"prob_{name}", p)
        both = F.array(F.lit(1.0) - F.col(f"prob_{name}"), F.col(f"prob_{name}"))
        return scored.withColumn(f"pred_{name}", (F.col(f"prob_{name}") > 0.5).cast("double")).withColumn(f"prob_{name}", array_to_vector(both))


def swapped_scores(model: TreesModel, pairs: DataFrame, label: str, size: int) -> DataFrame:
    """(j, label, p): scores of the vectors ``x`` with feature j taken from the vector ``other``, for each of the ``size`` features in turn."""
    packed = pairs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model.ensemble()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, found = cloudpickle.loads(packed.value)
        read = {int(j) for tree in found.trees for j in tree.feature if j >= 0}
        for batch in (b for b in batches if b.num_rows):
            own, other = (
                cutter.cut(batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(cutter.edges))) for c in ("x", "other")
            )
            as_is = found.probabilities(own)
            for j in range(size):
                p = as_is
                if j in read:  # the trees look at no other feature
                    kept, own[:, j] = own[:, j].copy(), other[:, j]
                    p = found.probabilities(own)
                    own[:, j] = kept
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), j, dtype=np.int32)), batch.column("label"), pa.array(p)], names=["j", "label", "p"])

    kind = pairs.schema[label].dataType.simpleString()
    return pairs.select(F.col(label).alias("label"), "x", "other").mapInArrow(score, f"j int, label {kind}, p double")


def fit_trees(df: DataFrame, plan: TreePlan, name: str, features: str = "features", label: str = "label", key: str = "key") -> TreesModel:
    """Grow one ensemble on all rows of ``df``."""
    table = bin_rows(df, features, label, key)
    (packed,) = _packed_ensembles(table, [Trial(plan)]) if table.fits() else (one.pack() for one in _grow_by_level(table, [Trial(plan)]))
    return TreesModel({"edges": table.bins.edges, "ensemble": packed, "plan": plan.as_dict()}, features=features, name=name)
