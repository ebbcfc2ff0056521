import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairforge.operators import packing, tokens
from pairforge.operators.position import with_batch


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, ids array<bigint>")


def test_wrapped_example(spark):
    rows = frame(spark, [(1, [1, 1, 1]), (2, [2, 2, 2]), (3, [3, 3])])
    got = packing.pack_wrapped(rows, "id", limit=4).orderBy("chunk").collect()
    assert [r["input_ids"] for r in got] == [[1, 1, 1, 2], [2, 2, 3, 3]]
    assert [r["position_ids"] for r in got] == [[0, 1, 2, 0], [1, 2, 0, 1]]
    assert [r["sequences"] for r in got] == [[1, 2], [2, 3]]
    assert [r["lengths"] for r in got] == [[3, 1], [2, 2]]


def test_wrapped_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(i * 5, [rng.randrange(99) for _ in range(rng.choice([0, 1, 3, 50]))]) for i in range(300)]
    stream = [t for _, ids in rows for t in ids]
    got = packing.pack_wrapped(frame(spark, rng.sample(rows, 300)), "id", limit=16).orderBy("chunk").collect()
    assert [r["input_ids"] for r in got] == [stream[i : i + 16] for i in range(0, len(stream), 16)]


def test_best_fit_keeps_every_token_once(spark):
    rng = random.Random(2)
    rows = [(i, [i * 1000 + j for j in range(rng.choice([0, 1, 7, 10, 33]))]) for i in range(400)]
    got = packing.pack_best_fit(frame(spark, rows), "id", limit=10).collect()
    assert sorted(t for r in got for t in r["input_ids"]) == sorted(t for _, ids in rows for t in ids)
    assert max(len(r["input_ids"]) for r in got) <= 10
    for r in got:
        assert sum(r["lengths"]) == len(r["input_ids"])
        at = 0
        for n in r["lengths"]:
            part = r["input_ids"][at : at + n]
            assert part == list(range(part[0], part[0] + n))
            assert r["position_ids"][at : at + n] == list(range(n))
            at += n


def test_best_fit_is_close_to_the_bound():
    rng = random.Random(0)
    counts = Counter(rng.randrange(1, 257) for _ in range(5000))
    plan, n_bins = packing.best_fit_plan(counts, 256)
    fill = Counter()
    for n, runs in plan:
        ends = [r[0] for r in runs[1:]] + [counts[n]]
        for (rank, take, first), end in zip(runs, ends):
            for r in range(rank, end):
                fill[first + (r - rank) // take] += n
    assert max(fill.values()) <= 256 and set(fill) == set(range(n_bins))
    assert sum(fill.values()) == sum(n * k for n, k in counts.items())
    assert n_bins <= 1.05 * sum(fill.values()) / 256


def one_by_one(lengths, limit):
    """Best fit decreasing, piece by piece: the bins' contents."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fitting = [b for b in bins if sum(b) + n <= limit]
        if fitting:
            max(fitting, key=sum).append(n)
        else:
            bins.append([n])
    return Counter(tuple(b) for b in bins)


def test_best_fit_on_counts_equals_best_fit_on_pieces():
    rng = random.Random(4)
    for limit in (5, 10, 37):
        for _ in range(60):
            lengths = [rng.randrange(1, limit) for _ in range(rng.randrange(1, 80))]
            counts = Counter(lengths)
            bins = {}
            for n, runs in packing.best_fit_plan(counts, limit)[0]:
                ends = [r[0] for r in runs[1:]] + [counts[n]]
                for (rank, take, first), end in zip(runs, ends):
                    for r in range(rank, end):
                        bins.setdefault(first + (r - rank) // take, []).append(n)
            assert Counter(tuple(b) for b in bins.values()) == one_by_one(lengths, limit)


def test_best_fit_with_equal_and_null_keys(spark):
    rows = [(1, [1, 2]), (1, [3, 4]), (None, [5, 6, 7]), (None, [8] * 9)]
    got = packing.pack_best_fit(frame(spark, rows), "id", limit=4).collect()
    assert sorted(t for r in got for t in r["input_ids"]) == sorted(t for _, ids in rows for t in ids)


def test_best_fit_takes_the_fullest_bin():
    # 6 and 5 open two bins; 4 closes the first, so 3 and 2 close the second.
    plan, n_bins = packing.best_fit_plan(dict.fromkeys([6, 5, 4, 3, 2], 1), 10)
    assert [(n, runs[0][2]) for n, runs in plan] == [(6, 0), (5, 1), (4, 0), (3, 1), (2, 1)] and n_bins == 2


def test_left_padding(spark):
    rows = frame(spark, [(0, [5]), (1, [6, 7])])
    got = packing.left_pad(with_batch(rows, "id", 2), 9).orderBy("id").collect()
    assert [r["input_ids"] for r in got] == [[9, 5], [6, 7]]
    assert [r["attention_mask"] for r in got] == [[0, 1], [1, 1]]


def labels(spark, ids, which="last"):
    rows = frame(spark, [(0, ids)])
    return rows.select(packing.completion_labels(F.col("ids"), 7, 0, which).alias("y")).first()["y"]


def test_completion_labels(spark):
    assert labels(spark, [1, 7, 2, 7, 3]) == [-100, -100, -100, -100, 3]
    assert labels(spark, [1, 7, 2, 7, 3], "first") == [-100, -100, 2, 7, 3]
    assert labels(spark, [0, 0, 1, 7, 2]) == [-100, -100, -100, -100, 2]
    assert labels(spark, [1, 2, 3]) == [-100] * 3
    assert labels(spark, [1, 2, 3], "first") == [-100] * 3


def test_flat_batches(spark):
    rows = frame(spark, [(0, [5, 6]), (1, [7]), (2, [8, 9])])
    got = packing.flatten_batches(with_batch(rows, "id", 2), "pos").orderBy("batch_id").collect()
    assert [r["input_ids"] for r in got] == [[5, 6, 7], [8, 9]]
    assert [r["position_ids"] for r in got] == [[0, 1, 0], [0, 1]]
    assert [r["labels"] for r in got] == [[-100, 6, -100], [-100, 9]]
    assert [r["cu_seqlens"] for r in got] == [[0, 2, 3], [0, 2]]


@pytest.mark.parametrize("n, padded", [(0, 0), (1, 8), (8, 8), (9, 16)])
def test_pad_to_multiple(spark, n, padded):
    rows = frame(spark, [(0, list(range(1, n + 1)))])
    got = rows.select(packing.pad_to_multiple(F.col("ids"), 0).alias("y")).first()["y"]
    assert got == list(range(1, n + 1)) + [0] * (padded - n)


def test_vocabulary_and_specials(spark):
    words = spark.createDataFrame([(["b", "a", "b"],), (["c", "a", "[SEP]"],)], "tokens array<string>")
    vocab = tokens.with_specials(tokens.vocabulary(words))
    assert {r["token"]: r["token_id"] for r in vocab.collect()} == {
        "a": 0, "b": 1, "[SEP]": 2, "c": 3, "<|endoftext|>": 4, "[PAD]": 5
    }


@pytest.mark.parametrize("head", [0, 2, 1000])
def test_encode_at_every_head_size(spark, head):
    rng = random.Random(4)
    rows = [(i, [rng.choice("aaaabcdefg") for _ in range(rng.randint(0, 20))]) for i in range(100)]
    df = spark.createDataFrame(rows, "id bigint, tokens array<string>")
    vocab = tokens.vocabulary(df)
    ids = {r["token"]: r["token_id"] for r in vocab.collect()}
    got = {r["id"]: r["ids"] for r in tokens.encode(df, "id", "tokens", vocab, head=head).collect()}
    assert got == {i: [ids[t] for t in words] for i, words in rows}


@pytest.mark.parametrize("unknown, want", [(None, [0, 0]), (99, [0, 99, 0])])
def test_unknown_words(spark, unknown, want):
    df = spark.createDataFrame([(1, ["a", "zz", "a"]), (2, [])], "id bigint, tokens array<string>")
    vocab = spark.createDataFrame([("a", 0)], "token string, token_id bigint")
    got = {r["id"]: r["ids"] for r in tokens.encode(df, "id", "tokens", vocab, unknown).collect()}
    assert got == {1: want, 2: []}


def test_only_missed_words_are_shuffled(spark, physical):
    df = spark.range(100).select("id", F.split(F.repeat(F.lit("a b "), 3), " ").alias("tokens"))
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("", 2)], "token string, token_id bigint")
    whole = tokens.encode(df, "id", "tokens", vocab)
    assert "Exchange" not in physical(whole)
    cut = tokens.encode(df, "id", "tokens", vocab, head=1)
    assert "Join" in physical(cut)
    assert cut.collect() == whole.collect() or sorted(cut.collect()) == sorted(whole.collect())


def test_null_lists_and_words(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [None, "a", None])], "id bigint, tokens array<string>")
    vocab = spark.createDataFrame([("a", 0)], "token string, token_id bigint")
    for head in (0, 10):
        got = {r["id"]: r["ids"] for r in tokens.encode(df, "id", "tokens", vocab, 9, head=head).collect()}
        assert got == {1: [], 2: [], 3: [0]}


def test_truncation(spark):
    rows = frame(spark, [(0, [1, 2, 3, 7])])
    row = rows.select(
        tokens.truncate(F.col("ids"), 3).alias("t"),
        tokens.separator_lost(F.col("ids"), 7, 3).alias("lost"),
        tokens.separator_lost(F.col("ids"), 7, 4).alias("kept"),
        tokens.separator_lost(F.col("ids"), 5, 3).alias("none"),
    ).first()
    assert (row["t"], row["lost"], row["kept"], row["none"]) == ([1, 2, 3], True, False, False)


def test_pair_limits(spark):
    df = spark.createDataFrame([(list(range(6)), list(range(10, 16)))], "p array<int>, c array<int>")
    for keep, prompt in (("end", [3, 4, 5]), ("start", [0, 1, 2])):
        cut, rest = tokens.truncate_pair(F.col("p"), F.col("c"), 3, 5, keep)
        assert df.select(cut.alias("a"), rest.alias("b")).first() == (prompt, [10, 11])
