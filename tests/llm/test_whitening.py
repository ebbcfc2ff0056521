"""Whitening against plain big-integer arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from pairforge.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, component string"
WIDE = "vec_id bigint, embedding array<double>, n string"


def plain(rows, k=4):
    """``{(vec_id, component): deviations}``, n, eigenvalues and trace, from Fractions."""
    fine = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = [len(v) for _, v in fine]
    d = max(sorted(set(sizes), reverse=True), key=sizes.count)
    fine = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in fine if len(v) == d]
    fit = sorted({tuple(v) for _, v in fine})
    n = len(fit)
    s = [sum(v[i] for v in fit) for i in range(d)]
    cov = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            total = sum((n * v[i] - s[i]) * (n * v[j] - s[j]) for v in fit)
            cov[i, j] = cov[j, i] = float(Fraction(total, n**3))
    deviations = [(i, sum((n * c - t) ** 2 for c, t in zip(v, s)), v) for i, v in fine]
    values, vectors = np.linalg.eigh(cov)
    return deviations, n, s, values[::-1][:k], vectors[:, ::-1][:, :k], np.trace(cov)


def check(found, rows, k=4):
    deviations, n, s, values, vectors, trace = plain(rows, k)
    by_row = {}
    for r in found:
        by_row.setdefault((r.vec_id, int(r.deviation)), {}).setdefault(r.component, []).append(r)
    assert sum(len(c) for v in by_row.values() for c in v.values()) == len(deviations) * k
    signs = np.ones(k)
    for i, far, v in deviations:
        own = by_row[i, far]
        mean = [Fraction(t, n) for t in s]
        u = np.array([float(c - m) for c, m in zip(v, mean)])
        wanted = (u @ vectors) / np.sqrt(values)
        for c in range(k):
            candidates = [r.whitened for r in own[c + 1]]
            if i == deviations[0][0]:
                signs[c] = 1.0 if min(abs(x - wanted[c]) for x in candidates) < 1e-6 else -1.0
            assert min(abs(x - signs[c] * wanted[c]) for x in candidates) < 1e-6
    for r in found:
        assert r.n == n and r.identity_error <= 1e-9
        assert abs(r.explained - values[r.component - 1] / trace) <= 1e-9


def test_op12(spark, sf, query):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = query(12)
    assert dict(found.dtypes)["deviation"] == "bigint"
    check(found.collect(), rows)


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in np.float32(rng.normal(size=6) * [9, 7, 5, 3, 1, 1])]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # many copies of one vector
    rows += [(7, rows[7][1]), (None, rows[8][1]), (7, rows[9][1])]
    rows += [(2000, None), (2001, []), (2002, [None] + [1.0] * 5), (2003, [float("nan")] * 6)]
    rows += [(2004, [float("-inf")] + [0.0] * 5), (2005, [1.0, 2.0]), (2006, [-0.0] * 6)]
    df = spark.createDataFrame([(*r, 1, "a", "b") for r in rows], SCHEMA).repartition(3)
    found = whitening.whiten(df)
    assert found.columns[:3] == ["vec_id", "component", "n"]
    check(found.collect(), rows)
    assert whitening.whiten(df.limit(0)).count() == 0
    alike = spark.createDataFrame([(i, [1.0, 2.0], 1, "", "") for i in range(5)], SCHEMA)
    assert whitening.whiten(alike).count() == 0


@pytest.mark.parametrize("offset", [0.0, 1e7, -3e12])
def test_large_offsets_lose_nothing(spark, offset):
    rng = np.random.default_rng(4)
    noise = rng.normal(size=(400, 5)) * [8, 6, 4, 2, 1]
    rows = [(i, [offset + float(c) for c in v]) for i, v in enumerate(noise)]
    df = spark.createDataFrame([(*r, "") for r in rows], WIDE)
    check(whitening.whiten(df, components=3).collect(), rows, 3)


def test_values_beyond_32_bits(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in rng.normal(size=3) * [4e9, 1e6, 1.0]]) for i in range(100)]
    found = whitening.whiten(spark.createDataFrame([(*r, "") for r in rows], WIDE), components=1).collect()
    check(found, rows, 1)
    huge = [(0, [1e300, 1.0]), (1, [-1e300, 2.0]), (2, [0.0, 3.0])]
    assert whitening.whiten(spark.createDataFrame([(*r, "") for r in huge], WIDE)).count() > 0


def test_packed_rows_are_equal_if_and_only_if_the_vectors_are():
    x = np.array([[1, 2], [1, 2], [1, -2], [40000, 0], [-(1 << 40), 3], [-(1 << 63), (1 << 63) - 1]], dtype=np.int64)
    raw = whitening.packed(x)
    assert raw[0] == raw[1] and len(set(raw.to_pylist())) == 5
    assert (whitening.unpacked(raw, 2) == x).all()
    rows, found = whitening.integers(pa.array([[-0.001, 0.5], None, [1.0]], type=pa.list_(pa.float32())), 2)
    assert rows.tolist() == [0] and found.tolist() == [[-1, 128]]


def test_limbs_add_up():
    values = [0, -1, 1 << 100, -(1 << 130) - 12345, 1 << 200]
    sums = np.sum([whitening._limbs(v) for v in values], axis=0, dtype=object)
    assert sum(int(v) << (whitening.LIMB * k) for k, v in enumerate(sums)) == sum(values)
