"""Dense groups of different vectors near the threshold lose no link, and the forest measures what it parts."""

import numpy as np
import pyarrow as pa
import pytest

from buyerscope.llm import embeddings


def frame(spark, vectors):
    flat = pa.FixedSizeListArray.from_arrays(pa.array(vectors.astype(np.float32).ravel()), vectors.shape[1]).cast(pa.list_(pa.float32()))
    return spark.createDataFrame(pa.table({"vec_id": np.arange(len(vectors)), "embedding": flat}))


@pytest.mark.parametrize("seed", [1, 2])
def test_a_dense_group_at_the_threshold_loses_no_link(spark, monkeypatch, seed):
    monkeypatch.setattr(embeddings, "LEAF_ROWS", 256)
    rng = np.random.default_rng(seed)
    wide = rng.standard_normal((6_000, 64))
    wide /= np.linalg.norm(wide, axis=1, keepdims=True)
    group = wide[0] + rng.standard_normal((2_500, 64)) / 8 * 0.2294
    vectors = np.concatenate([wide, group])
    got = embeddings.near_duplicates(frame(spark, vectors)).toPandas().sort_values("vec_id")
    x = vectors.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    assert linked.sum() > 1_000_000
    assert (got["n_links"].to_numpy() == linked.sum(axis=1)).all()


def test_the_number_of_trees_follows_from_what_they_part():
    rng = np.random.default_rng(3)
    wide = rng.standard_normal((8_000, 32))
    wide /= np.linalg.norm(wide, axis=1, keepdims=True)
    forest = embeddings.grow_forest(wide, 6, 0.95)
    assert embeddings.TREES[0] <= len(forest) < embeddings.TREES[1]
    # A dense group alone has nothing to split.
    tight = wide[0] + rng.standard_normal((4_000, 32)) / np.sqrt(32) * 0.2294
    tight /= np.linalg.norm(tight, axis=1, keepdims=True)
    assert all(not t.splits for t in embeddings.grow_forest(tight, 6, 0.95))


def test_lengths_that_the_sample_does_not_know_are_compared_too(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SAMPLE_ROWS", (20, 20))
    rows = [(i, [float(i + 1), 1.0, float(i % 7)]) for i in range(300)] + [(1_000, [1.0, 2.0]), (1_001, [2.0, 4.0]), (1_002, [2.0, -1.0])]
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got[1_000] == got[1_001] == 1 and got[1_002] == 0
