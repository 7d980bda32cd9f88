import math

import numpy as np
import pytest

from edgetide.llm import cholesky_whitening as cw
from edgetide.llm import queries as llm
from edgetide.llm.common import Scratch, table

SCHEMA = "vec_id long, embedding array<double>, x string, n int, i int, part int"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "q", 1, 2, 3) for i, v in zip(ids, vectors)], SCHEMA)


def brute(vectors):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    off = n * x - sums
    values, components = np.linalg.eigh((off.astype(float) / n).T @ (off.astype(float) / n) / n)
    return n, (off * off).sum(axis=1), off.astype(float) / n, values[::-1], components[:, ::-1]


def check(rows, vectors, ids, many=32):
    n, deviation, off, values, components = brute(vectors)
    assert len(rows) == len(vectors) * many
    at = {v: i for i, v in enumerate(ids)}
    by_component = {}
    for r in rows:
        assert r["n"] == n and r["deviation"] == deviation[at[r["vec_id"]]]
        assert abs(r["explained"] - values[r["component"] - 1] / values.sum()) <= 1e-9 * r["explained"]
        assert r["identity_error"] < 1e-9
        by_component.setdefault(r["component"], {})[at[r["vec_id"]]] = r["whitened"]
    for k, found in by_component.items():
        wanted = off @ components[:, k - 1] / math.sqrt(values[k - 1])
        given = np.array([found[i] for i in range(n)])
        assert min(np.abs(given - wanted).max(), np.abs(given + wanted).max()) < 1e-6
    assert sorted(by_component) == list(range(1, many + 1))


def test_whole_table_against_eigenvectors(spark, sf):
    given = table(spark, sf, "embeddings").collect()
    check(llm.q_op12_cholesky_whitening(spark, sf).collect(), [r["embedding"] for r in given], [r["vec_id"] for r in given])


def test_ill_conditioned_rows(spark):
    """Standard deviations from 1e6 down to about 1 grid step: the Gram matrix has a condition near 1e12."""
    dice = np.random.default_rng(1)
    vectors = dice.normal(size=(400, 6)) * np.array([1e5, 1e4, 1e3, 1e2, 1, 0.05]) @ np.linalg.qr(dice.normal(size=(6, 6)))[0]
    rows, n, d = cw.on_grid(frame(spark, vectors), Scratch(spark))
    model = cw.fit(rows, n, d)
    assert model.passes >= 2 and cw.identity_error(rows, model) < 1e-6
    _, _, off, _, _ = brute(vectors)
    assert np.allclose(np.sqrt(model.variances), np.linalg.svd(off, compute_uv=False) / math.sqrt(n), rtol=1e-8)


def test_constant_and_repeated_dimensions_are_no_components(spark):
    dice = np.random.default_rng(2)
    base = dice.normal(size=(60, 3))
    vectors = np.column_stack([base, np.full(60, 0.5), base[:, 0], base[:, 0] + base[:, 1]])
    grid = np.floor(64 * vectors)
    vectors[:, 5] = (grid[:, 0] + grid[:, 1]) / 64  # dependent on the grid, too
    rows = cw.whitened_components(frame(spark, vectors)).collect()
    assert {r["component"] for r in rows} == {1, 2, 3} and len(rows) == 180
    assert rows[0]["identity_error"] < 1e-6


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0], [1.0, 2.0], [3.0, -5.0], [0.5, 0.25]]
    bad = [None, [1.0, None], [nan, 1.0], [1.0, inf], [-inf, 0.0]]
    rows = cw.whitened_components(frame(spark, good + bad, [None, 5, 6, 7, 1, 2, 3, 4, 8])).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in rows) == sorted((v, c) for v in ("None", "5", "6", "7") for c in (1, 2))
    assert {r["n"] for r in rows} == {4}
    for few in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[], []], bad):
        assert cw.whitened_components(frame(spark, few)).count() == 0
    with pytest.raises(ValueError, match="entries"):
        cw.whitened_components(frame(spark, [[1.0], [1.0, 2.0]]))
    with pytest.raises(Exception, match="outside of the grid"):
        cw.whitened_components(frame(spark, [[1e300], [1.0]]))


def test_numbers_beyond_64_bits_raise_or_stay_exact(spark):
    x = np.array([[2**52, 5], [-2**52, 5]], dtype=np.int64)
    assert cw.exact(x, 4096, np.array([7, 3])).tolist() == [[2**64 - 7, 20477], [-2**64 - 7, 20477]]
    far = [[2.0**44], [-(2.0**44)], [1.0]]
    with pytest.raises(Exception, match="(?i)int|long|overflow"):
        cw.whitened_components(frame(spark, far)).collect()


def test_gram_is_the_same_over_many_partitions(spark):
    dice = np.random.default_rng(3)
    vectors = dice.normal(size=(700, 5)) * 40
    rows = spark.createDataFrame([(i, [int(c) for c in v]) for i, v in enumerate(vectors)], "vec_id long, x array<bigint>").repartition(600)
    wanted = np.floor(np.abs(vectors)) * np.sign(vectors)
    assert np.allclose(cw.gram(rows, 5, 5, lambda x: x.astype(float)), wanted.T @ wanted)
