import math
import random
from collections import Counter

import numpy as np

from pairforge.operators import bleu


def grams(words, n):
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def corpus(rows):
    match, total, pl, rl = [0] * 4, [0] * 4, 0, 0
    for p, refs in rows:
        p, refs = p.split(), [r.split() for r in refs]
        pl, rl = pl + len(p), rl + min(len(r) for r in refs)
        for n in range(1, 5):
            best = Counter()
            for r in refs:
                best |= grams(r, n)
            match[n - 1] += sum((grams(p, n) & best).values())
            total[n - 1] += max(len(p) - n + 1, 0)
    if pl == 0 or min(match) == 0:
        return match, total, pl, rl, 0.0
    mean = sum(math.log(m / t) for m, t in zip(match, total)) / 4
    return match, total, pl, rl, math.exp(mean) * (1.0 if pl > rl else math.exp(1 - rl / pl))


def text(rng, low=0, high=30):
    return " ".join(rng.choice("abcdef") for _ in range(rng.randint(low, high)))


def result(row):
    return (
        [row[f"match{n}"] for n in range(1, 5)], [row[f"total{n}"] for n in range(1, 5)],
        row["pred_len"], row["ref_len"],
    )


def check(df, rows, reference):
    row = bleu.corpus_bleu(df, "id", "p", reference).first()
    *counts, score = corpus(rows)
    assert result(row) == tuple(counts)
    assert math.isclose(row["bleu"], score, rel_tol=1e-12)


def test_corpus_bleu_against_plain_counts(spark):
    rng = random.Random(1)
    rows = [(text(rng), [text(rng)]) for _ in range(200)]
    df = spark.createDataFrame([(i, p, r[0]) for i, (p, r) in enumerate(rows)], "id bigint, p string, r string")
    check(df, rows, "r")


def test_several_references(spark):
    rng = random.Random(2)
    rows = [(text(rng), [text(rng) for _ in range(rng.randint(1, 3))]) for _ in range(100)]
    df = spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(rows)], "id bigint, p string, r array<string>")
    check(df, rows, "r")


def test_running_bleu_against_prefixes(spark):
    rng = random.Random(3)
    rows = [(text(rng, 4), [text(rng, 4)]) for _ in range(57)]
    df = spark.createDataFrame([(i, p, r[0]) for i, (p, r) in enumerate(rows)], "pos bigint, p string, r string")
    got = bleu.running_bleu(df, "pos", "p", "r", 10).orderBy("rows_done").collect()
    assert [r["rows_done"] for r in got] == [10, 20, 30, 40, 50]
    for r in got:
        *counts, score = corpus(rows[: r["rows_done"]])
        assert result(r) == tuple(counts)
        assert math.isclose(r["bleu"], score, rel_tol=1e-12)


def test_edge_scores(spark):
    def score(p, r):
        return bleu.corpus_bleu(spark.createDataFrame([(1, p, r)], "id bigint, p string, r string"), "id", "p", "r").first()["bleu"]

    assert score("", "a") == 0.0
    assert score("a b c", "a b c") == 0.0
    assert score("a b c d", "a b c d") == 1.0
    assert score("", "") == 0.0


def test_null_prediction_counts_as_empty(spark):
    df = spark.createDataFrame([(1, None, "a b"), (2, "a b c d e", "a b c d e")], "id bigint, p string, r string")
    row = bleu.corpus_bleu(df, "id", "p", "r").first()
    assert (row["pred_len"], row["ref_len"]) == (5, 7)


def test_group_of_empty_texts_is_kept(spark):
    df = spark.createDataFrame([(1, "x", "", "")], "id bigint, g string, p string, r string")
    assert bleu.corpus_bleu(df, "id", "p", "r", ["g"]).collect()[0]["bleu"] == 0.0


def test_texts_and_ngrams_never_move(spark, physical):
    df = spark.createDataFrame([], "id bigint, p string, r string")
    assert physical(bleu.row_counts(df, "id", "p", "r")).count("Exchange") == 0


def test_rows_of_lists_of_any_length(spark):
    rows = [(1, "a b", None), (2, "a b", []), (3, "a b", [None, "a b c"]), (4, None, ["x"]), (5, "a a a", ["a", "a a"])]
    df = spark.createDataFrame(rows, "id bigint, p string, r array<string>").repartition(2)
    got = {r["id"]: r for r in bleu.row_counts(df, "id", "p", "r").collect()}
    assert [got[i]["ref_len"] for i in range(1, 6)] == [0, 0, 0, 1, 1]
    assert [got[i]["pred_len"] for i in range(1, 6)] == [2, 2, 2, 0, 3]
    assert [got[i]["match1"] for i in range(1, 6)] == [0, 0, 2, 0, 2]
    assert got[5]["match2"] == 1 and got[5]["total2"] == 2


def test_slices_have_every_row_once():
    from pairforge.operators import arrow

    rng = random.Random(8)
    rows = [(text(rng), [text(rng) for _ in range(rng.randint(1, 3))]) for _ in range(60)]
    sizes = [len(p) + sum(map(len, r)) for p, r in rows]
    assert list(arrow.slices(np.array(sizes), 1)) == [(i, 1) for i in range(60)]
    assert [at for at, _ in arrow.slices(np.array([300, 1, 1, 300, 1]), 10)] == [0, 1, 3, 4]
    assert sum(n for _, n in arrow.slices(np.array(sizes), 200)) == 60
    assert list(arrow.slices(np.array([], dtype=np.int64))) == []


def test_targets_by_id(spark):
    p = spark.createDataFrame([(1, "x"), (2, "y")], "id bigint, p string")
    t = spark.createDataFrame([(2, "v"), (1, "u"), (3, "w w")], "id bigint, t string")
    got = bleu.with_targets(p, t, "id").orderBy("id").select("p", "t").collect()
    assert got == [("x", "u"), ("y", "v"), ("", "w w")]
    alone = bleu.corpus_bleu(bleu.with_targets(p, t.where("id = 3"), "id"), "id", "p", "t").first()
    assert (alone["ref_len"], alone["pred_len"], alone["bleu"]) == (2, 0, 0.0)
