"""Whitening against a dense computation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, whitening
from millrace.llm.common import table


def dense(vectors, most=16, copies=False):
    """Per distinct x: deviation and whitened values up to sign, with n, explained and the eigenvalues."""
    x = [tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in vectors]
    fit = sorted(x) if copies else sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[float(n * c - s) / n for c, s in zip(v, sums)] for v in fit])
    values, basis = np.linalg.eigh(y.T @ y / n)
    values, basis = values[::-1], basis[:, ::-1]
    varies = values[:most] > 1e-9 * values[0]
    white = (y @ basis)[:, :most] / np.sqrt(np.where(varies, values[:most], np.nan))
    deviations = {v: sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in fit}
    return x, n, deviations, dict(zip(fit, white)), values[:most] / values.sum()


def compare(found, ids, vectors, copies=False, most=16):
    x, n, deviations, white, explained = dense(vectors, most, copies)
    by_id = {}
    for r in found:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    assert len(found) == len(ids) * min(most, len(vectors[0])) and set(by_id) == set(ids)
    k = min(most, len(vectors[0]))
    got = np.array([[by_id[i][c].whitened if by_id[i][c].whitened is not None else np.nan for c in range(1, k + 1)] for i in ids])
    want = np.array([white[v] for v in x])
    sign = np.sign(np.nansum(got * want, axis=0))
    np.testing.assert_allclose(got, want * np.where(sign == 0, 1, sign), atol=1e-8)
    for i, v in zip(ids, x):
        for c, r in by_id[i].items():
            assert (r.n, r.deviation) == (n, deviations[v]) and abs(r.explained - explained[c - 1]) < 1e-9
    assert len({r.identity_error for r in found}) == 1
    return found[0].identity_error


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding").collect()
    found = queries.op11(spark, folder).collect()
    assert compare(found, [r.vec_id for r in rows], [r.embedding for r in rows]) < 1e-8


@pytest.mark.parametrize("weights", ["one", "copies"])
def test_copies(spark, weights):
    rng = np.random.default_rng(7)
    kinds = rng.normal(size=(60, 5)).tolist()
    vectors = [kinds[0]] * 200 + [kinds[i] for i in rng.integers(0, 60, 300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(7)
    found = whitening.whiten(df, weights=weights, common_share=0.1).collect()
    assert compare(found, range(500), vectors, copies=weights == "copies") < 1e-9
    assert whitening.whiten(df, weights=weights, most=2).where("component > 2").count() == 0


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (6, [1e300, 0.0]), (7, [0.5, 1.0]),
        (7, [0.5, 1.0]), (None, [0.25, -1.0]), (8, [2.0, 0.25]), (9, [1.0, 2.0, 3.0]), (10, [5.0]), (11, [6.0]), (11, [7.0]),
    ]
    names = "id dims x copies n component place value".split()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in names})
    found = whitening.whiten(df).collect()
    assert sorted((r.vec_id or 0, r.component) for r in found) == [
        (0, 1), (0, 2), (7, 1), (7, 1), (7, 2), (7, 2), (8, 1), (8, 2), (9, 1), (9, 2), (9, 3), (10, 1), (11, 1), (11, 1)]
    alone = [r for r in found if r.vec_id == 9]
    assert all((r.n, r.deviation, r.whitened, r.explained) == (1, 0, None, None) for r in alone)
    two = {(r.vec_id, r.component): r for r in found if r.vec_id in (None, 7, 8)}
    assert {r.n for r in two.values()} == {3} and max(r.identity_error for r in two.values()) < 1e-9
    line = [r for r in found if r.vec_id in (10, 11)]
    assert sorted(round(r.whitened / math.sqrt(1.5), 9) for r in line) == [-1, 0, 1] and {r.explained for r in line} == {1.0}
    assert whitening.whiten(df.where("vec_id > 99")).collect() == []
    with pytest.raises(ValueError):
        whitening.whiten(df, weights="many")


def test_far_apart_numbers(spark):
    """Sums and deviations stay exact beyond 2**53; a deviation beyond 64 bits is null."""
    vectors = [[2.0**40 + 0.25], [2.0**40 + 1.0], [-3.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    found = {r.vec_id: r for r in whitening.whiten(df).collect()}
    x = [math.floor(64 * v[0]) + 1_000_000 for v in vectors]
    want = [(3 * v - sum(x)) ** 2 for v in x]
    assert [found[i].deviation for i in range(3)] == [v if v < 2**63 else None for v in want] and None in [found[i].deviation for i in range(3)]
    assert found[0].identity_error < 1e-9
