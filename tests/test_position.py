import random

import pytest
from pyspark.sql import functions as F

from pairforge.operators import position

KEYS = {
    "dense": list(range(10_000)),
    "sparse": sorted(random.Random(1).sample(range(-(2**61), 2**61), 3000)),
    "clustered": list(range(500)) + [2**40 + i for i in range(500)] + [2**62 + 7],
}


@pytest.mark.parametrize("kind", KEYS)
@pytest.mark.parametrize("bits", [18, 3])
def test_prefix_sums_against_a_loop(spark, monkeypatch, kind, bits):
    # Few bits force several levels of totals.
    monkeypatch.setattr(position, "TOTAL_BITS", bits)
    monkeypatch.setattr(position, "ROW_BITS", 12 if bits == 18 else 4)
    rng = random.Random(2)
    rows = [(k, rng.choice([None, 0, 1, 7])) for k in KEYS[kind][:: 1 if bits == 18 else 3]]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k bigint, v int")
    got = position.prefix_sums(df, "k", {"s": F.col("v"), "n": F.lit(1)}).orderBy("k").collect()
    total, want = 0, []
    for i, (k, v) in enumerate(rows):
        want.append((k, v, total, i))
        total += v or 0
    assert [tuple(r) for r in got] == want


def test_running_totals(spark):
    df = spark.range(5000).select("id", F.expr("if(id % 5 = 0, null, id % 5)").alias("v"))
    got = position.running_totals(df, "id", {"s": F.col("v")}).orderBy("id").collect()
    total = 0
    for r in got:
        total += r["v"] or 0
        assert r["s"] == total


def test_no_window_sees_a_data_table(spark, physical, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = physical(position.with_position(docs.select("doc_id", "text"), "doc_id"))
    single = [part for part in plan.split("Exchange ") if part.startswith("SinglePartition")]
    assert len(single) == 1 and "totals" in single[0] and "text#" not in single[0]
    assert "Exchange hashpartitioning(_bucket" in plan
    assert plan.count("FileScan") == 2  # the table and the group totals


def test_batches(spark):
    df = spark.range(10).select((F.col("id") * 7).alias("k"))
    got = position.with_batch(df, "k", 4).orderBy("k").collect()
    assert [r["batch_id"] for r in got] == [0] * 4 + [1] * 4 + [2] * 2


@pytest.mark.parametrize("n, train", [(19_045, 17_140), (1, 0), (10, 9)])
def test_split_sizes(spark, n, train):
    parts = position.split_by_position(spark.range(n), "id").groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {
        k: v for k, v in (("train", train), ("eval", n - train)) if v
    }


def test_ranked_with_a_hot_value(spark):
    rows = [(1 if i % 3 else i, f"r{i:05d}") for i in range(6000)]
    df = spark.createDataFrame(rows, "v int, name string").repartition(7)
    got = position.ranked(df, [F.desc("v"), F.col("name")]).orderBy("rank").collect()
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [(r["v"], r["name"], r["rank"]) for r in got] == [(*r, i) for i, r in enumerate(want, 1)]


def test_ranked_of_nothing(spark):
    df = spark.createDataFrame([], "v int, name string")
    assert position.ranked(df, [F.col("v"), F.col("name")]).collect() == []


def test_seeded_shuffle_is_repeatable(spark):
    a = position.seeded_shuffle(spark.range(500), "id", 1).orderBy("pos").collect()
    b = position.seeded_shuffle(spark.range(500).repartition(3), "id", 1).orderBy("pos").collect()
    c = position.seeded_shuffle(spark.range(500), "id", 2).orderBy("pos").collect()
    assert a == b != c
    assert sorted(r["id"] for r in a) == list(range(500))


@pytest.mark.parametrize("keys", [[1, None, 3], [1, 2, 2, 3]])
def test_null_and_repeated_keys_raise(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    with pytest.raises(Exception, match="k is null|k repeats"):
        position.with_position(df, "k").collect()
