"""Whitening against numpy's own decomposition, and its edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm import whitening
from marquee.llm.queries import QUERIES


@pytest.mark.parametrize("make", [
    lambda r: r.standard_normal((1, 1)), lambda r: r.standard_normal((2, 2)), lambda r: r.standard_normal((40, 40)),
    lambda r: np.eye(10), lambda r: np.zeros((5, 5)), lambda r: np.diag([1.0, 1, 2, 2, 3, 0, 0]),
    lambda r: np.ones((6, 6)), lambda r: r.standard_normal((30, 3)) @ r.standard_normal((3, 30)),
])
def test_components(make):
    a = make(np.random.default_rng(2))
    a = a @ a.T
    k = min(16, len(a))
    values, vectors = whitening.leading_components(a, k)
    scale = max(np.abs(a).max(), 1e-300)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:k], rtol=0, atol=1e-13 * len(a) * scale)
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * len(a) * scale
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12


def test_sturm_count():
    rng = np.random.default_rng(4)
    diagonal, off = rng.standard_normal(20), rng.standard_normal(19)
    form = np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1)
    at = np.linspace(-4, 4, 50)
    assert (whitening.smaller(diagonal, off, at) == (np.linalg.eigvalsh(form)[None, :] < at[:, None]).sum(axis=1)).all()


def test_query(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.floor(np.stack(rows.embedding).astype(float) * 64).astype(np.int64) + 1_000_000
    once = np.unique(x, axis=0)
    n, sums = len(once), once.sum(axis=0)
    z = (n * once - sums) / n
    v = z.T @ z / n
    e, q = (a[..., ::-1][..., :16] for a in np.linalg.eigh(v))
    got = QUERIES["op12_whiten"](spark, tiny).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 16 * len(rows) and (got.n == n).all() and (got.identity_error < 1e-9).all()
    assert (got.deviation.to_numpy().reshape(-1, 16) == ((n * x - sums) ** 2).sum(axis=1)[:, None]).all()
    assert np.allclose(got.explained.to_numpy().reshape(-1, 16), e / np.trace(v), rtol=1e-10)
    mine, ref = got.whitened.to_numpy().reshape(-1, 16), ((n * x - sums) / n) @ q / np.sqrt(e)
    assert np.abs(np.abs(mine) - np.abs(ref)).max() < 1e-9
    assert got.dtypes["component"] == np.int32 and got.dtypes["deviation"] == np.int64


SCHEMA = "vec_id long, embedding array<float>, x string, n string, component string"


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [
        (1, [0.0, 1.0, 2.0]), (1, [0.0, 1.0, 2.0]), (None, [1.0, 0.5, 7.0]), (2, None), (3, []), (4, [1.0, None, 2.0]), (5, [1.0, nan, 0.0]),
        (6, [1.0, inf, 0.0]), (7, [1.0, 2.0]), (8, [3.0, -1.0, 0.25]), (9, [2.0, 2.0, 2.0]), (10, [-5.0, 1e20, 1.0]),
    ]
    rows = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in vectors], SCHEMA)
    got = whitening.whiten(rows).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((i, c) for i in ("1", "1", "None", "8", "9") for c in (1, 2, 3))
    assert {r.n for r in got} == {4}
    whole = np.floor(np.array([[0, 1, 2], [1, 0.5, 7], [3, -1, 0.25], [2, 2, 2]]) * 64).astype(int) + 1_000_000
    assert {int(r.deviation) for r in got} == set(((4 * whole - whole.sum(axis=0)) ** 2).sum(axis=1).tolist())
    same = spark.createDataFrame([(1, [1.0, 2.0])] * 5, "vec_id long, embedding array<double>")
    assert whitening.whiten(same).collect() == []
    assert whitening.whiten(rows.where("vec_id is null and vec_id = 1")).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(line).collect()} == {1}


def test_entries_beyond_64_bits(spark):
    rows = spark.createDataFrame([(i, [float(2**35 * i), float(i)]) for i in range(1, 40)], "vec_id long, embedding array<double>")
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(rows).where("component = 1").collect()}
    x = {i: (2**41 * i + 1_000_000, 64 * i + 1_000_000) for i in range(1, 40)}
    sums = [sum(v[k] for v in x.values()) for k in (0, 1)]
    assert got == {i: sum((39 * v[k] - sums[k]) ** 2 for k in (0, 1)) for i, v in x.items()}


def test_hot_vector_is_counted_once(spark):
    base = spark.range(3000).select(
        F.col("id").alias("vec_id"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit(0.5), F.lit(0.25))).otherwise(F.array(F.rand(1), F.rand(2))).alias("embedding"),
    )
    got = whitening.whiten(base)
    assert got.count() == 6000 and got.first().n == len({tuple(np.floor(np.array(r.embedding) * 64)) for r in base.collect()})
