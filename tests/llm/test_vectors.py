"""Nearest and near-duplicate vectors against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.llm import ann, embed_dedup

SCHEMA = "vec_id bigint, embedding array<float>, label int, node string, pass string"


def clean(rows):
    return [
        r for r in rows
        if r[1] is not None and len(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])
    ]


def odd_vectors():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(200):
        rows.append((i, [float(x) for x in np.float32(rng.normal(size=16) * (1 + i % 3))], i % 2))
    base = rng.normal(size=16)
    for i in range(120):  # a large group of near copies, and many exact ones
        v = base if i % 2 else base + 0.05 * rng.normal(size=16)
        rows.append((1000 + i, [float(x) for x in np.float32(v)], 1))
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] + [1.0] * 15, 1)]
    rows += [(2004, [float("inf")] + [1.0] * 15, 1), (2005, [None] + [1.0] * 15, 1), (2006, rows[0][1], None)]
    rows += [(7, rows[7][1], 1), (7, rows[7][1], 1), (None, rows[7][1], 1), (2007, [1.0, 2.0], 0), (2020, [2.0, 4.0], 0)]
    return [(*r, "x", "y") for r in rows]


def links(rows, cosine=0.98):
    """Number of links and smallest id reachable for each row."""
    found = {i: 0 for i in range(len(rows))}
    root = list(range(len(rows)))
    fine = {id(r) for r in clean(rows)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    unit = {}
    for i, r in enumerate(rows):
        if id(r) in fine and r[2] is not None:
            v = np.array(r[1], dtype=np.float64)
            unit[i] = v / np.linalg.norm(v)
    ids = list(unit)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            same = rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j])
            if same and unit[i] @ unit[j] >= cosine:
                found[i] += 1
                found[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        ids = least.setdefault(find(i), [])
        ids += [r[0]] if r[0] is not None else []
    return [(str(r[0]), found[i], str(min(least[find(i)], default=None))) for i, r in enumerate(rows)]


@pytest.fixture(scope="module")
def vectors(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def test_op9(query, vectors):
    rows = [(r.vec_id, r.embedding, r.label) for r in vectors.collect()]
    found = [(str(r.vec_id), r.n_links, str(r.component_id)) for r in query(9).collect()]
    assert sorted(found) == sorted(links(rows))


def test_links_of_odd_vectors(spark):
    rows = odd_vectors()
    found = embed_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in found) == sorted(links(rows))
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert embed_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def exact(rows, asks, k):
    """All pairs, brute force."""
    fine = clean(rows)
    size = max((len(r[1]) for r in fine), default=0)
    x = np.array([list(r[1]) + [0.0] * (size - len(r[1])) for r in fine], dtype=np.float64)
    out = {}
    for i, r in enumerate(fine):
        if r[0] is not None and asks(r[0]):
            s = x @ x[i]
            order = sorted((-s[j], c[0] is None, c[0] or 0) for j, c in enumerate(fine) if c[0] != r[0])
            out[r[0]] = [(None if none else v, -score) for score, none, v in order[:k]]
    return out


def recall(found, wanted):
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == set(wanted)
    shares = []
    for q, want in wanted.items():
        own = sorted(by[q])
        assert [r[0] for r in own] == list(range(1, len(want) + 1))
        assert all(a[2] >= b[2] for a, b in zip(own, own[1:]))
        scores = dict(want)
        for _, v, s in own:
            assert v not in scores or abs(scores[v] - s) < 1e-9
        shares.append(len({v for _, v, _ in own} & set(scores)) / len(want))
    return np.mean(shares)


def test_op1_recall(query, vectors):
    rows = [(r.vec_id, r.embedding, r.label) for r in vectors.collect()]
    assert recall(query(1).collect(), exact(rows, lambda v: v % 20 == 0, 20)) >= 0.95


def test_search_of_odd_vectors(spark):
    rows = [r for r in odd_vectors() if r[0] != 7]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = ann.nearest(df, F.col("vec_id") % 10 == 0, 5).collect()
    assert recall(found, exact(rows, lambda v: v % 10 == 0, 5)) >= 0.95
    few = df.where("vec_id < 4")
    assert recall(ann.nearest(few, F.lit(True), 5).collect(), exact([r for r in rows if r[0] in range(4)], lambda v: True, 5)) == 1
    assert ann.nearest(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0


def test_several_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 60)
    monkeypatch.setattr(ann, "QUERIES", 7)
    rows = [r for r in odd_vectors() if r[0] is not None and r[0] < 1000 and r[0] != 7]
    found = ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, 5).collect()
    assert recall(found, exact(rows, lambda v: v % 10 == 0, 5)) >= 0.9


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("case", ["near 1e-3", "near 1e-4", "one long"])
def test_close_and_long_vectors(spark, case):
    """Near copies that differ by little, beside others, and one vector that is much longer than the rest."""
    rng = np.random.default_rng(4)
    if case == "one long":
        x = rng.normal(size=(2_000, 64))
        x[17] *= 1e4
    else:
        near = unit(unit(rng.normal(size=(1, 64))) + float(case.split()[1]) * rng.normal(size=(1_500, 64)))
        x = np.concatenate([near, unit(rng.normal(size=(500, 64)))])
    x = np.float32(x)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    found: dict[int, set] = {}
    for r in ann.nearest(df.repartition(4), F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    x = x.astype(np.float64)
    shares = []
    for q in range(0, len(x), 20):
        score = x @ x[q]
        score[q] = -np.inf
        shares.append(len(found[q] & set(np.argsort(-score, kind="stable")[:20].tolist())) / 20)
    assert np.mean(shares) >= 0.95


def test_double_vectors(spark):
    """Components that only double precision tells apart, and norms beyond its range."""
    base = np.ones(8)
    rows = [(i, [float(c) for c in base * (1 + i * 1e-12)]) for i in range(60)] + [(90, [1e200] * 8), (91, [1e-200] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = {r.rank: r.vec_id for r in ann.nearest(df, F.col("vec_id") == 10, 5).collect()}
    assert found == {1: 90, 2: 59, 3: 58, 4: 57, 5: 56}


def test_crowded_label_loses_no_link(spark):
    """Vectors that all lie in one direction, with planted pairs among them."""
    rng = np.random.default_rng(9)
    middle = rng.normal(size=64)
    middle /= np.linalg.norm(middle)
    noise = rng.normal(size=(5_000, 64))
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    x = middle + 0.25 * noise
    near = x[:60] + 0.012 * rng.normal(size=(60, 64)) / 8 ** 0.5
    x = np.float32(np.concatenate([x, near]))
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    close = u @ u.T >= 0.98
    np.fill_diagonal(close, False)
    assert 60 <= close.sum() / 2 <= 2_000
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(4)
    found = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df).collect()}
    assert found == dict(enumerate(close.sum(axis=1).tolist()))
