import numpy as np
import pytest
from pyspark.sql import types as T

from tallyscope.llm import embedding_dedup
from tallyscope.llm.embedding_dedup import near_vectors

SCHEMA = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("size", T.StringType())]
)


def vectors():
    rng = np.random.default_rng(9)
    rows = []
    for label in (0, 1):
        for _ in range(12):
            base = rng.standard_normal(16)
            for _ in range(int(rng.integers(1, 9))):
                rows.append((base + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.25]), label))
    hot = rng.standard_normal(16)
    rows += [(hot * rng.uniform(0.5, 3) + rng.standard_normal(16) * 0.05, 0) for _ in range(150)]
    order = rng.permutation(len(rows))
    return [(int(7 * k % 9973), [float(np.float32(x)) for x in rows[i][0]], rows[i][1], "x") for k, i in enumerate(order)]


def brute(rows):
    ids = np.array([r[0] for r in rows])
    a = np.array([r[1] for r in rows], np.float32).astype(float)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (a @ a.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    comp = ids.copy()
    while True:
        new = np.array([min(comp[k], comp[near[k]].min(initial=comp[k])) for k in range(len(ids))])
        if (new == comp).all():
            return {i: (int(n), int(c)) for i, n, c in zip(ids, near.sum(1), comp, strict=True)}
        comp = new


@pytest.mark.parametrize("block", [512, 40])
def test_links_and_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = vectors()
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    found, every = sum(r.n_links for r in got.values()), sum(n for n, _ in want.values())
    assert all(got[k].n_links <= want[k][0] for k in want) and found >= 0.98 * every
    assert {k: r.component_id for k, r in got.items()} == {k: c for k, (_, c) in want.items()}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_unusable_vectors_link_with_nothing(spark):
    one = [1.0] * 4
    rows = [(1, one, 0, ""), (2, one, 0, ""), (3, one, None, ""), (4, None, 0, ""), (5, [0.0] * 4, 0, ""), (6, [1.0, None, 1.0, 1.0], 0, "")]
    rows += [(7, [float("nan")] * 4, 0, ""), (8, [float("inf")] + one[1:], 0, ""), (9, [], 0, ""), (10, [1.0] * 5, 0, ""), (11, one, 1, "")]
    rows += [(None, one, 0, ""), (2, one, 0, ""), (12, [1e-20] * 4, 0, "")]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[12] == (2, 1, False)
    assert all(got[k] == (0, k, True) for k in range(3, 12)) and got[None] == (0, None, True)


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
