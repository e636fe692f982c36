"""Linear models on Spark: many penalized regressions and margin machines in one pass per Newton step.

A step needs, per model, the loss, its slope and its curvature summed over the rows: matrix products of a block of rows with the
coefficients of all models. As with trees, a table of at most ``BLOCK_ROWS`` rows is dealt whole to one task per model; a larger one
stays where it is, and one job serves a step of all models of a wave, which solve their own system and send back one direction.

The margin machine minimizes the hinge loss with a rounded corner (``CORNERS``, narrower from stage to stage), by the same steps.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buyerscope.models.boosting import NO_FOLD
from buyerscope.models.trees import sigmoid
from buyerscope.operators.base import JsonModel
from buyerscope.storage import write_once

CORNERS = (2.0, 0.5, 0.1)  # widths of the rounded corner of the hinge, in margins
WAVE_BYTES = 1 << 26  # sums of one step that a task may hold
STEPS = 100
BLOCK_ROWS = 1 << 16  # largest table that one task may hold
PARTS = 3  # parts of the training rows that calibrate a margin


@dataclass(frozen=True)
class LinearPlan:
    """What decides a linear model, apart from its rows: ``loss`` is ``logistic`` or ``hinge``, ``gamma`` of the Gaussian kernel or None."""

    loss: str = "logistic"
    c: float = 1.0
    balanced: bool = False
    intercept_too: bool = False  # the penalty covers the intercept
    gamma: str | None = None
    dims: int = 256
    tol: float = 1e-6
    seed: int = 42


def linear_plan(kind: str, params: dict[str, Any], seed: int = 42) -> LinearPlan:
    """The plan of ``logistic_regression`` or ``svm``; a parameter that the learner does not have raises an error.

    The solver ``liblinear`` penalizes the intercept as well; the others differ in their steps and not in their solution.
    """
    given = dict(params)
    weight = given.pop("class_weight", None)
    if weight not in (None, "balanced"):
        raise ValueError(f"unknown class_weight {weight}")
    common = {"c": float(given.pop("C", 1.0)), "balanced": weight == "balanced", "seed": seed, "tol": float(given.pop("tol", 1e-6))}
    given.pop("max_iter", None)  # an upper limit for solvers that take many small steps
    if kind == "logistic_regression":
        solver, penalty = given.pop("solver", "lbfgs"), given.pop("penalty", "l2")
        if penalty != "l2" or solver not in ("lbfgs", "liblinear", "saga", "sag", "newton-cg", "newton-cholesky"):
            raise ValueError(f"no solver {solver} with penalty {penalty}")
        plan = LinearPlan(**common, intercept_too=solver == "liblinear")
    elif kind == "svm":
        kernel, gamma = given.pop("kernel", "rbf"), given.pop("gamma", "scale")
        if kernel not in ("linear", "rbf") or gamma not in ("scale", "auto"):
            raise ValueError(f"no kernel {kernel} with gamma {gamma}")
        plan = LinearPlan(**common, loss="hinge", gamma=gamma if kernel == "rbf" else None, dims=int(given.pop("dims", 256)))
    else:
        raise ValueError(f"unknown learner: {kind}")
    if given:
        raise ValueError(f"{kind} has no parameters {sorted(given)}")
    return plan


# --- rows ---------------------------------------------------------------------------------------


@dataclass
class Design:
    """From raw features to the columns of a model: standardized, and lifted to cosine features for a Gaussian kernel; the last is 1."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray | None = None
    shifts: np.ndarray | None = None

    @property
    def width(self) -> int:
        return (len(self.mean) if self.shifts is None else len(self.shifts)) + 1

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) * self.scale
        if self.shifts is not None:
            z = np.sqrt(2.0 / len(self.shifts)) * np.cos(z @ self.directions + self.shifts)
        return np.column_stack([z, np.ones(len(z))])


def cosine_directions(gamma: float, size: int, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random directions and shifts whose cosines approximate the Gaussian kernel."""
    draw = np.random.default_rng(seed)
    return draw.normal(0.0, np.sqrt(2 * gamma), (size, dims)), draw.uniform(0.0, 2 * np.pi, dims)


@dataclass
class Rows:
    """Rows ``key, mark, label, fold, x`` in the shared folder with what the models need to know of them, by fold."""

    table: DataFrame
    sizes: dict[tuple[int, int], int]  # (fold, label) -> rows
    moments: dict[int, tuple[int, np.ndarray, np.ndarray]]  # fold -> rows, means, population variances

    @property
    def n_rows(self) -> int:
        return sum(self.sizes.values())

    def classes(self, plan: LinearPlan, fold: int) -> tuple[float, float]:
        no, yes = (sum(n for (f, y), n in self.sizes.items() if y == c and f != fold) for c in (0, 1))
        if not plan.balanced:
            return 1.0, 1.0
        return (no + yes) / (2 * max(no, 1)), (no + yes) / (2 * max(yes, 1))

    def design(self, plan: LinearPlan, fold: int, standardize: bool = True) -> Design:
        """Fitted on the rows outside ``fold``; constant features become 0."""
        parts = [m for f, m in self.moments.items() if f != fold]
        n = sum(m[0] for m in parts)
        mean = sum(m[0] * m[1] for m in parts) / n
        variance = sum(m[0] * (m[2] + (m[1] - mean) ** 2) for m in parts) / n
        flat = variance <= 1e-24 * (1 + mean**2)
        scale = np.where(flat, 0.0, 1.0 / np.sqrt(np.where(flat, 1.0, variance)))
        if not standardize:
            mean, scale = np.zeros_like(mean), np.ones_like(scale)
        if plan.gamma is None:
            return Design(mean, scale)
        size = len(mean)
        spread = float(np.mean(variance * scale**2) + np.var((sum(m[0] * m[1] for m in parts) / n - mean) * scale))
        gamma = 1.0 / size if plan.gamma == "auto" or spread <= 0 else 1.0 / (size * spread)
        return Design(mean, scale, *cosine_directions(gamma, size, plan.dims, plan.seed))


def linear_rows(df: DataFrame, features: str = "features", label: str = "label", key: str | None = "key", fold: str | None = None) -> Rows:
    """Write what the models read; sums by fold and label come from one aggregate."""
    x = vector_to_array(F.col(features))
    mark = F.xxhash64(F.col(key)) if key and key in df.columns else F.xxhash64(x)
    table = write_once(
        df.select((F.col(key) if key and key in df.columns else mark).alias("key"), mark.alias("mark"), F.col(label).cast("double").alias("label"), (F.col(fold).cast("int") if fold else F.lit(0)).alias("fold"), x.alias("x")),
        "linear_rows",
    )
    summary = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("x")).alias("s")
    sizes = {(r["fold"], int(r["label"])): r["n"] for r in table.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
    moments = {}
    for r in table.groupBy("fold").agg(summary).collect():  # one row per fold
        n = r["s"]["count"]
        moments[r["fold"]] = (n, r["s"]["mean"].toArray(), r["s"]["variance"].toArray() * ((n - 1) / n if n > 1 else 0.0))
    return Rows(table, sizes, moments)


# --- one model ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """A model to fit on the rows outside ``fold``."""

    plan: LinearPlan
    fold: int = NO_FOLD


def step_sums(z: np.ndarray, y: np.ndarray, weight: np.ndarray, theta: np.ndarray, loss: str, corner: float) -> np.ndarray:
    """Loss, slope and curvature of one block in one array: [loss, slope..., curvature...]."""
    f = z @ theta
    if loss == "logistic":
        p = sigmoid(f)
        value = np.logaddexp(0.0, f) - y * f
        slope, bend = p - y, p * (1 - p)
    else:
        sign = 2 * y - 1
        short = 1 - sign * f
        value = np.where(short <= 0, 0.0, np.where(short >= corner, short - corner / 2, short**2 / (2 * corner)))
        slope = -sign * np.clip(short / corner, 0.0, 1.0)
        # The straight part has no curvature; a little keeps the system solvable.
        bend = np.where(short <= 0, 0.0, np.where(short < corner, 1.0, 1e-3)) / corner
    root = np.sqrt(weight * bend)
    live = np.flatnonzero(root)  # rows without weight or beyond the corner bend nothing
    scaled = z * root[:, None] if len(live) == len(z) else z[live] * root[live, None]
    # The product of a matrix with itself costs half of a product of two.
    return np.concatenate([[weight @ value], z.T @ (weight * slope), (scaled.T @ scaled).ravel()])


def solve(sums: np.ndarray, theta: np.ndarray, plan: LinearPlan, penalty: float) -> tuple[float, float, np.ndarray]:
    """(penalized loss, decrement, Newton direction) at ``theta``."""
    d = len(theta)
    ridge = np.full(d, penalty)
    if not plan.intercept_too:
        ridge[-1] = 0.0
    slope = sums[1 : d + 1] + ridge * theta
    bend = sums[d + 1 :].reshape(d, d) + np.diag(ridge + 1e-9)
    direction = -np.linalg.solve(bend, slope)
    return float(sums[0] + 0.5 * (ridge * theta) @ theta), float(-slope @ direction), direction


class Newton:
    """Damped Newton steps of one model: asks for the sums at ``theta`` until it is ``done``."""

    def __init__(self, plan: LinearPlan, width: int):
        self.plan, self.theta = plan, np.zeros(width)
        self.corners = list(CORNERS) if plan.loss == "hinge" else [0.0]
        self.base, self.length, self.steps, self.done = None, 1.0, 0, False

    @property
    def corner(self) -> float:
        return self.corners[0]

    def take(self, loss: float, decrement: float, direction: np.ndarray) -> None:
        self.steps += 1
        if self.base is not None and loss > self.base[1] + 1e-12 * (1 + abs(self.base[1])) and self.length > 1e-8:
            self.length /= 2  # too far: half of the last step
            self.theta = self.base[0] + self.length * self.base[2]
            return
        if decrement <= self.plan.tol**2 * (1 + abs(loss)) or self.steps >= STEPS:
            self.base, self.length = None, 1.0
            self.corners = self.corners[1:]
            self.done = not self.corners or self.steps >= STEPS
            self.corners = self.corners or [CORNERS[-1]]
            return
        self.base, self.length = (self.theta, loss, direction), 1.0
        self.theta = self.theta + direction


def _weights(label: np.ndarray, classes: tuple[float, float]) -> np.ndarray:
    return np.where(label == 1, classes[1], classes[0])


def _parts(mark: np.ndarray) -> np.ndarray:
    return (mark.view(np.uint64) % np.uint64(PARTS)).astype(np.int64)


CURVE = LinearPlan(tol=1e-6)


def fit_block(z: np.ndarray, label: np.ndarray, mark: np.ndarray, plan: LinearPlan, classes: tuple[float, float]) -> dict[str, Any]:
    """Coefficients of one model, and for a margin the curve that turns it into a probability, from the rows of one block."""
    weight = _weights(label, classes)

    def fit(rows: np.ndarray, columns: np.ndarray, one: LinearPlan, w: np.ndarray, penalty: float) -> np.ndarray:
        newton = Newton(one, columns.shape[1])
        while not newton.done:
            newton.take(*solve(step_sums(columns[rows], label[rows], w[rows], newton.theta, one.loss, newton.corner), newton.theta, one, penalty))
        return newton.theta

    every = np.arange(len(label))
    out = {"theta": fit(every, z, plan, weight, 1.0 / plan.c)}
    if plan.loss == "hinge":
        part, margins = _parts(mark), np.zeros(len(label))
        for q in range(PARTS):
            margins[part == q] = z[part == q] @ fit(np.flatnonzero(part != q), z, plan, weight, 1.0 / plan.c)
        out["curve"] = fit(every, np.column_stack([margins, np.ones(len(label))]), CURVE, np.ones(len(label)), 0.0)
    return out


def probabilities(z: np.ndarray, fitted: dict[str, Any]) -> np.ndarray:
    f = z @ np.asarray(fitted["theta"])
    curve = fitted.get("curve")
    return sigmoid(f if curve is None else curve[0] * f + curve[1])


# --- many models ----------------------------------------------------------------------------------


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return x, batch.column("label").to_numpy(), batch.column("fold").to_numpy(), batch.column("mark").to_numpy()


def fit_models(rows: Rows, models: Sequence[Model], standardize: bool = True, block_rows: int | None = None) -> list[dict[str, Any]]:
    """Coefficients of all models, in their order."""
    designs = [rows.design(m.plan, m.fold, standardize) for m in models]
    classes = [rows.classes(m.plan, m.fold) for m in models]
    if rows.n_rows > (BLOCK_ROWS if block_rows is None else block_rows):
        return _fit_by_steps(rows, models, designs, classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            number = held[0].column("slot")[0].as_py()
            x, label, fold, mark = (np.concatenate(c) for c in zip(*map(_arrays, held), strict=True))
            on = np.flatnonzero(fold != models[number].fold)
            on = on[np.argsort(mark[on], kind="stable")]
            found = fit_block(designs[number](x[on]), label[on], mark[on], models[number].plan, classes[number])
            fitted = json.dumps({k: v.tolist() for k, v in found.items()})
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([fitted])], names=["model", "fitted"])

    slots = F.explode(F.sequence(F.lit(0), F.lit(len(models) - 1))).alias("slot")
    dealt = rows.table.select(slots, "mark", "label", "fold", "x").repartitionById(len(models), F.col("slot"))
    found = {r["model"]: json.loads(r["fitted"]) for r in dealt.mapInArrow(run, "model long, fitted string").collect()}
    return [found[i] for i in range(len(models))]


def _fit_by_steps(rows: Rows, models: Sequence[Model], designs: list[Design], classes: list[tuple[float, float]]) -> list[dict[str, Any]]:
    """The same over a table that stays where it is: machines, then their parts, then the curves over the parts' margins."""
    own = [(i, -1) for i in range(len(models))]
    parts = [(i, q) for i, m in enumerate(models) if m.plan.loss == "hinge" for q in range(PARTS)]
    thetas = _descend(rows, models, designs, classes, [*own, *parts], None)
    out = [{"theta": thetas[i, -1].tolist()} for i in range(len(models))]
    margins = [i for i, m in enumerate(models) if m.plan.loss == "hinge"]
    if margins:
        for (i, _), theta in _descend(rows, models, designs, classes, [(i, PARTS) for i in margins], thetas).items():
            out[i]["curve"] = theta.tolist()
    return out


def _descend(
    rows: Rows, models: Sequence[Model], designs: list[Design], classes: list[tuple[float, float]], asked: list[tuple[int, int]],
    machines: dict[tuple[int, int], np.ndarray] | None,
) -> dict[tuple[int, int], np.ndarray]:
    """Fit (model, part) pairs, a wave at a time; with ``machines`` given, the curves over the margins that the parts have not seen."""
    curves = machines is not None
    width = 2 if curves else max(d.width for d in designs)
    together = max(1, WAVE_BYTES // (8 * (width + 1) ** 2))
    context, out = rows.table.sparkSession.sparkContext, {}
    for start in range(0, len(asked), together):
        wave = asked[start : start + together]
        plans = [CURVE if curves else models[i].plan for i, _ in wave]
        newtons = [Newton(p, 2 if curves else designs[i].width) for p, (i, _) in zip(plans, wave, strict=True)]
        while not all(n.done for n in newtons):
            packed = context.broadcast(pickle.dumps([(k, n.theta, n.corner) for k, n in enumerate(newtons) if not n.done]))
            for k, loss, decrement, direction in _one_step(rows, models, designs, classes, wave, plans, machines, packed):
                newtons[k].take(loss, decrement, np.array(direction))
            packed.unpersist()
        out |= {pair: n.theta for pair, n in zip(wave, newtons, strict=True)}
    return out


def _one_step(rows, models, designs, classes, wave, plans, machines, packed) -> Iterator[tuple]:
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, sums = pickle.loads(packed.value), {}
        for batch in (b for b in batches if b.num_rows):
            x, label, fold, mark = _arrays(batch)
            part, made = _parts(mark), {}
            for k, theta, corner in work:
                i, q = wave[k]
                if id(designs[i]) not in made:
                    made[id(designs[i])] = designs[i](x)
                z, on = made[id(designs[i])], (fold != models[i].fold) & (part != q)
                weight = np.ones(len(label))
                if machines is None:
                    weight = _weights(label, classes[i])
                else:
                    unseen = np.stack([z @ machines[i, p] for p in range(PARTS)], axis=1)[np.arange(len(z)), part]
                    z = np.column_stack([unseen, weight])
                sums[k] = sums.get(k, 0.0) + step_sums(z, label, weight * on, theta, plans[k].loss, corner)
        for k, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([s.tobytes()], pa.binary())], names=["model", "sums"])

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = {k: theta for k, theta, _ in pickle.loads(packed.value)}
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals[k] = totals.get(k, 0.0) + np.frombuffer(s, dtype=np.float64)
        for k, total in totals.items():
            loss, decrement, direction = solve(total, work[k], plans[k], 0.0 if machines is not None else 1.0 / plans[k].c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k]), pa.array([loss]), pa.array([decrement]), pa.array([direction.tolist()])], names=["model", "loss", "decrement", "direction"]
            )

    parts = rows.table.mapInArrow(add_up, "model long, sums binary").repartition("model")
    for r in parts.mapInArrow(turn, "model long, loss double, decrement double, direction array<double>").collect():
        yield r["model"], r["loss"], r["decrement"], r["direction"]


def held_out_linear(rows: Rows, models: Sequence[Model], candidates: Sequence[int], block_rows: int | None = None) -> DataFrame:
    """(candidate, fold, key, label, p) of the rows in each model's fold; all models are applied in one pass."""
    designs = [rows.design(m.plan, m.fold) for m in models]
    fitted = fit_models(rows, models, block_rows=block_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            x, label, fold, _ = _arrays(batch)
            for model, design, found, candidate in zip(models, designs, fitted, candidates, strict=True):
                on = np.flatnonzero(fold == model.fold)
                if len(on):
                    p = probabilities(design(x[on]), found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(on), candidate, dtype=np.int32)), pa.array(fold[on]), batch.column("key").take(pa.array(on)), pa.array(label[on]), pa.array(p)],
                        names=["candidate", "fold", "key", "label", "p"],
                    )

    kind = rows.table.schema["key"].dataType.simpleString()
    return rows.table.mapInArrow(score, f"candidate int, fold int, key {kind}, label double, p double")


# --- the fitted stage -----------------------------------------------------------------------------


class LinearModel(JsonModel):
    """Coefficients over a vector column, and the curve of a margin machine, as a pipeline stage."""

    DEFAULTS = {"features": "scaled", "name": "model"}

    @property
    def coefficients(self) -> DenseVector:
        return DenseVector(self.state()["theta"][:-1])

    @property
    def intercept(self) -> float:
        return self.state()["theta"][-1]

    def getFeaturesCol(self) -> str:  # noqa: N802 - the name that Spark's own models use
        return self.opt("features")

    def getRegParam(self) -> float:  # noqa: N802
        """Penalty per unit of weight."""
        return self.state()["penalty"]

    def _transform(self, df: DataFrame) -> DataFrame:
        name, fitted = self.opt("name"), self.state()

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                x = np.array(batch.tolist(), dtype=np.float64).reshape(len(batch), len(fitted["theta"]) - 1)
                yield pd.Series(probabilities(np.column_stack([x, np.ones(len(x))]), fitted))

        scored = df.withColumn(f"prob_{name}", score(vector_to_array(F.col(self.opt("features")))))
        both = F.array(F.lit(1.0) - F.col(f"prob_{name}"), F.col(f"prob_{name}"))
        return scored.withColumn(f"pred_{name}", (F.col(f"prob_{name}") > 0.5).cast("double")).withColumn(f"prob_{name}", array_to_vector(both))


def fit_linear(df: DataFrame, plan: LinearPlan, name: str, features: str, label: str = "label", key: str = "key") -> LinearModel:
    """Fit one model on vectors that are ready for it (standardized, and lifted where there is a kernel)."""
    rows = linear_rows(df, features, label, key)
    ready = replace(plan, gamma=None)
    (found,) = fit_models(rows, [Model(ready)], standardize=False)
    total = sum(n * rows.classes(ready, NO_FOLD)[y] for (_, y), n in rows.sizes.items())
    return LinearModel({**found, "penalty": 1.0 / (plan.c * total)}, features=features, name=name)


__all__ = ["LinearModel", "LinearPlan", "Model", "fit_linear", "fit_models", "held_out_linear", "linear_plan", "linear_rows"]
