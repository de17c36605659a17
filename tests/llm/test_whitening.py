"""Whitening against numpy on the whole table, and on odd rows."""

import math

import numpy as np
import pytest

from threatlake.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def brute(vectors, weights="counts"):
    """Per vector: deviation, whitened; and explained, identity error."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], object)
    fit = x if weights == "counts" else np.array(sorted({tuple(r) for r in x}), object)
    n, s = len(fit), fit.sum(0)
    deviation = [int(((n * r - s) ** 2).sum()) for r in x]
    centred = lambda m: ((n * m - s) / n).astype(np.float64)
    v = centred(fit).T @ centred(fit) / n
    e, u = np.linalg.eigh(v)
    e, u = np.maximum(e[::-1][:32], 1e-9), u[:, ::-1][:, :32]
    return n, deviation, centred(x) @ (u / np.sqrt(e)), e / max(np.trace(v), 1e-9)


def compare(found, ids, vectors, k, weights="counts"):
    n, deviation, white, explained = brute(vectors, weights)
    got = {}
    for r in found:
        got.setdefault((r.vec_id, r.component), []).append(r)
    assert len(found) == len(ids) * k
    signs = {}
    for i, (vec, d) in enumerate(zip(ids, deviation)):
        for c in range(k):
            for r in got[vec, c + 1]:
                assert (r.n, r.deviation) == (n, d)
                assert abs(r.explained - explained[c]) <= 1e-9 * explained[c]
                assert r.identity_error < 1e-8
                if abs(white[i, c]) > 1e-6:
                    signs.setdefault(c, set()).add(bool((r.whitened > 0) == (white[i, c] > 0)))
                assert abs(abs(r.whitened) - abs(white[i, c])) < 1e-6
    assert all(len(s) == 1 for s in signs.values())


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    compare(queries.op13_whitening(spark, SF).collect(), [r.vec_id for r in rows], [r.embedding for r in rows], 32)


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_odd_rows(spark, weights):
    rng = np.random.default_rng(2)
    pool = (rng.normal(size=(30, 5)) * 3).round(4).tolist()
    good = [(i, pool[i % 7 if i < 60 else i % 30]) for i in range(120)] + [(None, pool[3]), (5, pool[5]), (5, pool[5]), (200, [-0.001, 1e4, -2.5, 3.0, 0.0])]
    bad = [(300, None), (301, []), (302, [1.0, None, 0.0, 0.0, 0.0]), (303, [float("nan"), 0.0, 0.0, 0.0, 0.0]), (304, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (305, [0.0, -float("inf"), 0.0, 0.0, 0.0]), (306, [1e300, 0.0, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, 7, "q") for i, v in good + bad], "vec_id long, embedding array<double>, _k int, whitened string").repartition(5)
    found = whitening.by_component(whitening.whiten(spark, table, weights=weights)).collect()
    got = {(r.vec_id, r.component) for r in found}
    assert got == {(i, c) for i, _ in good for c in range(1, 6)}
    n, deviation, white, explained = brute([v for _, v in good], weights)
    for r in found:
        at = [k for k, (i, _) in enumerate(good) if i == r.vec_id]
        assert r.n == n and r.deviation in [deviation[k] for k in at]
        assert any(abs(abs(r.whitened) - abs(white[k, r.component - 1])) < 1e-6 for k in at)
        assert r.identity_error <= 1e-4
    assert len(found) == 5 * len(good)


def test_small_tables(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.by_component(whitening.whiten(spark, table.limit(0))).count() == 0
    one = whitening.whiten(spark, table).collect()
    assert [(r.n, r.copies, int(r.deviation), r.whitened) for r in one] == [(2, 2, 0, [])] * 2
    assert whitening.by_component(whitening.whiten(spark, table)).count() == 0
    mixed = table.union(spark.createDataFrame([(3, [1.0, 0.0, 5.0]), (4, [0.0, 0.0, 5.0]), (5, [3.0, 2.0])], table.schema))
    got = {r.vec_id: r for r in whitening.whiten(spark, mixed).collect()}
    assert [(got[i].size, got[i].n, len(got[i].whitened)) for i in (1, 3, 5)] == [(2, 3, 1), (3, 2, 1), (2, 3, 1)]
    with pytest.raises(ValueError):
        whitening.whiten(spark, table, weights="two")


def test_wide_sums(spark):
    """Sums beyond longs stay exact."""
    rows = [(i, [float(2**45), -float(2**45) + i]) for i in range(5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    _, deviation, _, _ = brute([v for _, v in rows])
    found = whitening.whiten(spark, table)
    assert sorted(int(r.deviation) for r in found.collect()) == sorted(deviation)
    assert {r.deviation for r in whitening.by_component(found).collect()} == {d if d < 2**63 else None for d in deviation}
