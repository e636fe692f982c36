import numpy as np
import pandas as pd
import pytest

from buyerscope.operators import neighbours
from buyerscope.operators.neighbours import Cells, classify, nearest_neighbours
from buyerscope.operators.smote import oversample


def frame(spark, x, start=0, **extra):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(start, start + len(x)), "v": list(x), **extra}))


def brute(q, b, k, p, q_ids, b_ids, skip):
    out = {}
    for i, row in enumerate(q):
        d = np.abs(b - row).sum(1) if p == 1 else np.sqrt(((b - row) ** 2).sum(1))
        cand = sorted((d[j], b_ids[j]) for j in range(len(b)) if not (skip and b_ids[j] == q_ids[i]))
        out[q_ids[i]] = [c[1] for c in cand[:k]]
    return out


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["base_id"])
    return out


@pytest.mark.parametrize("p", [1, 2])
def test_neighbours_match_brute_force(spark, p):
    rng = np.random.default_rng(7)
    b = np.concatenate([rng.normal(size=(120, 3)), rng.normal(5, 0.1, size=(80, 3))])
    q = rng.normal(1, 2, size=(60, 3))
    want = brute(q, b, 4, p, range(1000, 1060), range(200), False)
    asked, base = frame(spark, q, 1000), frame(spark, b)
    assert collected(nearest_neighbours(asked, base, 4, p)) == want
    grouped = nearest_neighbours(asked, base, 4, p, pivots=9, block_rows=16)
    assert collected(grouped) == want


def test_a_third_equal_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 4, size=(150, 2)).astype(float)
    x[::3] = 1.0
    rows = frame(spark, x)
    want = brute(x, x, 5, 2, range(150), range(150), True)
    assert collected(nearest_neighbours(rows, rows, 5, skip_same_id=True)) == want
    grouped = nearest_neighbours(rows, rows, 5, skip_same_id=True, block_rows=8)
    assert collected(grouped) == want


def test_fewer_rows_than_neighbours(spark):
    x = np.array([[0.0], [1.0], [5.0]])
    rows = frame(spark, x)
    for size in (1, 100):
        got = nearest_neighbours(rows, rows, 5, skip_same_id=True, block_rows=size)
        assert collected(got) == {0: [1, 2], 1: [0, 2], 2: [1, 0]}
    assert nearest_neighbours(rows, rows.limit(0), 5).count() == 0


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_bounds_never_exclude_and_mostly_prune(p, scale):
    rng = np.random.default_rng(p)
    x = rng.uniform(size=(4000, 2)) * scale
    cells = Cells(x[:60], p)
    cell, r = cells.place(x)
    unit_of = cells.close({c: ((cell == c).sum(), r[cell == c].max()) for c in np.unique(cell).tolist()}, 200)
    units = np.array([unit_of[c] for c in cell.tolist()])
    q = x[:300]
    d = np.abs(q[:, None] - x[None]).sum(2) if p == 1 else np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    limit = np.sort(d, axis=1)[:, 5]
    reached = cells.within(q, limit)
    row, col = np.nonzero(d <= limit[:, None])
    assert reached[row, units[col]].all()
    assert reached.mean() < 0.4  # visits of units, of all possible


def test_visits_of_embeddings_are_bounded(spark):
    """In 64 dimensions a query row is sent at most once to each unit, and units hold a block of rows."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id id", "cast(embedding as array<double>) v")
    x = np.array([r["v"] for r in rows.collect()])
    cells = Cells(x[:44], 2)
    cell, r = cells.place(x)
    unit_of = cells.close({c: ((cell == c).sum(), r[cell == c].max()) for c in np.unique(cell).tolist()}, 1024)
    n_units = len(set(unit_of.values()))
    assert n_units <= 2 * len(x) / 1024 + 1
    assert cells.within(x, np.full(len(x), np.inf)).sum() <= len(x) * n_units


def test_probes_find_most_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 16)).repeat(25, axis=0) + rng.normal(0, 0.1, size=(1000, 16))
    rows = frame(spark, x)
    want = brute(x, x, 5, 2, range(1000), range(1000), True)
    got = collected(nearest_neighbours(rows, rows, 5, skip_same_id=True, probes=4))
    assert np.mean([len(set(got.get(i, [])) & set(w)) / 5 for i, w in want.items()]) >= 0.9


def test_a_row_is_sent_once_per_shelf_and_brings_back_only_what_is_within_reach():
    """Sixty dimensions, where the bounds rule out nothing: what is shuffled does not grow with the number of units."""
    rng = np.random.default_rng(11)
    shelves = neighbours.Shelves([900, 1100, 1000, 5000, 800, 1000], 2048)
    assert shelves.spans == [(0, 2, range(0, 1)), (2, 3, range(1, 2)), (3, 4, range(2, 5)), (4, 6, range(5, 6))]
    assert neighbours.Shelves([1000] * 4000, neighbours._side(4_000_000, 1024)).spans[-1][2][0] < 4000 / 50
    at, masks = shelves.visits(np.array([[1, 0, 0, 1, 0, 1], [0, 0, 0, 0, 0, 0]], dtype=bool))
    assert at == [[0, 2, 3, 4, 5], []] and [m[0] >> 6 for m in masks[0]] == [2, 2, 2, 2, 1]
    x = np.concatenate([rng.normal(size=(300, 60)) * 1e3 + 1e6, np.full((3, 60), 1e200), np.full((2, 60), np.nan)])
    found = neighbours._Best(np.arange(305), x, np.full(305, np.inf), np.arange(305), x, 4, 2, True)
    for start in range(0, 305, 61):
        found.search(np.arange(305), np.arange(start, start + 61))
    got = found.rows().groupby("query_id")["base_id"].apply(list).to_dict()
    want = brute(x[:300], x[:300], 4, 2, range(300), range(300), True)
    assert got == {**want, 300: [301, 302], 301: [300, 302], 302: [300, 301]}
    d = np.sort(np.sqrt(((x[:300, None] - x[None, :300]) ** 2).sum(2)), axis=1)
    near = neighbours._Best(np.arange(300), x[:300], d[:, 2], np.arange(300), x[:300], 4, 2, True)
    near.search(np.arange(300), np.arange(300))
    assert (near.rows().groupby("query_id").size() == 2).all()


def test_votes(spark):
    base = frame(spark, np.array([[0.0], [1.0], [3.0]]), label=[1, 0, 0])
    asked = frame(spark, np.array([[0.0], [0.9]]), 10)
    uniform = {r["query_id"]: r["p"] for r in classify(asked, base, 3).collect()}
    assert uniform == {10: pytest.approx(1 / 3), 11: pytest.approx(1 / 3)}
    weighted = {r["query_id"]: r["p"] for r in classify(asked, base, 3, "distance").collect()}
    near = (1 / 0.9) / (1 / 0.9 + 1 / 0.1 + 1 / 2.1)
    assert weighted == {10: 1.0, 11: pytest.approx(near)}


def test_oversampling_balances_and_interpolates(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 2))
    x[50:] = x[50]  # Copies in the minority.
    labels = [0] * 41 + [1] * 19
    df = spark.createDataFrame(pd.DataFrame({"ID": range(60), "Target": labels, "a": x[:, 0], "b": x[:, 1]}))
    out = oversample(df, ["a", "b"]).toPandas()
    assert (out["Target"] == 0).sum() == (out["Target"] == 1).sum() == 41
    assert not out.duplicated(["ID", "synthetic"]).any()
    new = out[out["synthetic"] > 0]
    rare = x[41:]
    for _, r in new.iterrows():
        point, start = np.array([r["a"], r["b"]]), x[int(r["ID"])]
        # On the segment from the row to some minority row.
        ok = False
        for other in rare:
            step = other - start
            t = 0.0 if not step.any() else float(np.dot(point - start, step) / np.dot(step, step))
            ok = ok or (0 <= t <= 1 and np.allclose(start + t * step, point))
        assert ok
    again = oversample(df.repartition(5), ["a", "b"]).toPandas()
    key = ["ID", "synthetic"]
    assert np.allclose(out.sort_values(key)[["a", "b"]], again.sort_values(key)[["a", "b"]])
