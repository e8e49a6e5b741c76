"""Whitening against numpy on the same whole numbers."""

import math

import numpy as np
import pytest

from tipoff.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, vectors, schema=SCHEMA):
    return spark.createDataFrame([(k, None if v is None else [None if e is None else float(e) for e in v], 0) for k, v in enumerate(vectors)], schema)


def plain(vectors):
    """Per usable row: n, deviation, and the centred vector's squared projections; with the explained shares."""
    usable = {k: tuple(math.floor(256 * float(np.float32(e))) for e in v) for k, v in enumerate(vectors)
              if v is not None and all(e is not None and math.isfinite(e) for e in v)}
    fit = np.array(sorted(set(usable.values())), float)
    n, centred = len(fit), fit - fit.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    sums = [sum(int(r[d]) for r in fit) for d in range(fit.shape[1])]
    rows = {}
    for k, x in usable.items():
        deviation = sum((n * int(v) - s) ** 2 for v, s in zip(x, sums))
        rows[k] = (n, deviation, (np.array(x) - fit.mean(axis=0)) @ axes / np.sqrt(np.maximum(values, 1e-30)))
    return rows, values / values.sum()


@pytest.mark.parametrize("block_vectors", [4096, 7])
def test_equals_numpy(spark, block_vectors):
    rng = np.random.default_rng(1)
    vectors = list(rng.normal(size=(150, 6)) * [3, 2, 1, 0.5, 0.4, 0.3]) + [[1, 2, 3, 4, 5, 6]] * 60 + [None, [1, 2, None, 4, 5, 6], [1, 2, math.inf, 4, 5, 6], [math.nan] * 6]
    expected, explained = plain(vectors)
    found = whiten(table(spark, vectors), block_vectors=block_vectors).collect()
    assert sorted((r.vec_id, r.component) for r in found) == [(k, c) for k in sorted(expected) for c in (1, 2, 3, 4)]
    signs = {}
    for r in found:
        n, deviation, y = expected[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9) and r.identity_error < 1e-9
        sign = signs.setdefault(r.component, np.sign(r.whitened * y[r.component - 1]))
        assert r.whitened == pytest.approx(sign * y[r.component - 1], rel=1e-8, abs=1e-9)


def test_given_vectors(spark, sf_dir):
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = [r.embedding for r in embeddings.orderBy("vec_id").collect()]
    expected, _ = plain(vectors)
    found = whiten(embeddings).collect()
    assert len(found) == 4 * len(expected) and {(r.vec_id, r.deviation) for r in found} == {(k, x[1]) for k, x in expected.items()}


def test_components_without_variance_are_left_out(spark):
    assert {r.component for r in whiten(table(spark, [[1, 2, 5], [2, 4, 5], [3, 6, 5]])).collect()} == {1}
    assert whiten(table(spark, [[1, 2]] * 5)).count() == 0
    assert whiten(table(spark, [[], []])).count() == 0


def test_short_vectors_are_filled_with_zeros(spark):
    one = whiten(table(spark, [[1, 2], [3], [0, 5], []])).orderBy("vec_id", "component").collect()
    other = whiten(table(spark, [[1, 2], [3, 0], [0, 5], [0, 0]])).orderBy("vec_id", "component").collect()
    assert one == other and len(one) == 8


def test_repeated_and_missing_ids_and_clashing_columns(spark):
    rows = [(1, [1.0, 0.0], 3, 9), (1, [0.0, 2.0], 4, 9), (None, [5.0, 1.0], 5, 9), (1, [1.0, 0.0], 3, 9)]
    found = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long, x long")).collect()
    assert len(found) == 8 and {r.n for r in found} == {3} and sum(r.vec_id is None for r in found) == 2


def test_deviation_beyond_a_long_is_null(spark):
    found = whiten(spark.createDataFrame([(1, [1e15]), (2, [-1e15]), (3, [0.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: r.deviation for r in found} == {1: None, 2: None, 3: 0}
    assert whiten(spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [2.0])], "vec_id long, embedding array<double>")).count() == 3


def test_empty_table(spark):
    empty = whiten(table(spark, []))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
