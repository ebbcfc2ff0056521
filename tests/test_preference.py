import random

from pyspark.sql import functions as F

from pairforge.operators import generate, preference
from pairforge.operators.position import with_batch

SCHEMA = "pair_id bigint, src string, tgt string, pred1 string, pred2 string"


def judge(spark, rows, **rules):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    return preference.classify(df, **rules).orderBy("pair_id")


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_tie_takes_the_second(spark):
    r = judge(spark, [("s", "ad", "ab", "ac")], min_gap=0).first()
    assert (r["status"], r["chosen"], r["rejected"], r["chosen_dist"], r["rejected_dist"]) == (
        "kept", "ac", "ab", 1, 1,
    )


def test_ratio_bounds_are_kept(spark):
    long30, short10 = "a" * 30, "b" * 10
    rows = [
        ("s", long30, long30, short10), ("s", "a" * 31, "a" * 31, short10),
        ("s", "a" * 33, "a" * 33, "b" * 100), ("s", "a" * 32, "a" * 32, "b" * 100),
    ]
    assert [r["status"] for r in judge(spark, rows).collect()] == [
        "kept", "length_ratio", "kept", "length_ratio"
    ]


def test_first_rule_wins(spark):
    rows = [
        ("s", None, "a", "b"), (None, "t", "a", "b"), ("s", "t", "", ""), ("s", "t", None, "b"),
        ("s", "t", "a", "a"), ("s", "tt", "ta", "tb"), ("s", "tttt", "tttt", "aaab"),
    ]
    assert [r["status"] for r in judge(spark, rows).collect()] == [
        "error", "error", "empty", "empty", "identical", "small_diff", "kept"
    ]


def test_distance_counts_characters(spark):
    r = judge(spark, [("s", "été", "ete", "xxxxxx")]).first()
    assert (r["chosen"], r["chosen_dist"]) == ("ete", 2)


def test_distances_beyond_every_band_are_exact(spark):
    random.seed(3)
    rows = []
    for n in (5, 40, 300, 700):
        t = "".join(random.choice("abcd é") for _ in range(n))
        rows.append(("s", t, t[: n // 2], "".join(random.choice("wxyz") for _ in range(n))))
    got = judge(spark, rows, min_ratio=0.0, max_ratio=1e9).collect()
    for (_, t, p1, p2), r in zip(rows, got):
        assert (r["chosen_dist"], r["rejected_dist"]) == tuple(sorted([edit_distance(p1, t), edit_distance(p2, t)]))


def test_counts_add_up_and_rates_are_null_without_kept_rows(spark):
    judged = judge(spark, [("s", "t", "a", "a"), ("s", None, "a", "b")])
    report = preference.outcome_report(judged).first()
    assert (report["total_processed"], report["skipped_identical"], report["successful"]) == (1, 1, 0)
    assert report["success_rate"] is None and report["mean_chosen_dist"] is None
    assert {r["status"]: r["n"] for r in preference.outcome_counts(judged).collect()} == {
        "identical": 1, "error": 1
    }


def test_kept_pairs_have_the_bare_source(spark):
    judged = judge(spark, [("src", "target", "target", "something else")])
    assert preference.kept_pairs(judged).collect() == [("src", "target", "something else")]


def test_running_success_against_a_loop(spark):
    random.seed(5)
    rows = [(i * 3, random.choice(["kept", "empty", "error"])) for i in range(1000)]
    df = spark.createDataFrame(random.sample(rows, 1000), "k bigint, status string")
    got = preference.success_so_far(with_batch(df, "k", 7), 20).orderBy("batch_id").collect()
    want = []
    for b in range(20, (len(rows) + 6) // 7, 20):
        seen = [s for _, s in rows[: (b + 1) * 7] if s != "error"]
        want.append((b, len(seen), seen.count("kept"), 100.0 * seen.count("kept") / len(seen)))
    assert [tuple(r) for r in got] == want


def test_distances_are_worked_out_once(spark, physical):
    df = spark.createDataFrame([], SCHEMA)
    plan = physical(preference.kept_pairs(preference.classify(df)))
    # Two texts, each by the bands and the full form, none repeated by a filter.
    assert plan.count("levenshtein(") == 2 * (len(preference.BANDS) + 1)


def test_tasks_follow_the_size(spark, physical):
    def tasks(rows: int) -> int:
        df = spark.range(rows).select(
            F.col("id").alias("pair_id"), F.lit("s").alias("src"), F.repeat(F.lit("t"), 40).alias("tgt"),
            F.lit("a").alias("pred1"), F.lit("a").alias("pred2"),
        )
        judged = preference.classify(df, spread_by="pair_id")
        assert "REBALANCE" in physical(judged)
        return judged.select(F.spark_partition_id().alias("p"), "status").distinct().count()

    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes",)}
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
        assert tasks(200_000) > 2 * tasks(20_000)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def failing():
    def make():
        def fn(prompts, setting):
            if any("bad" in p for p in prompts):
                raise RuntimeError("no")
            return [p + "A<|endoftext|>" for p in prompts]

        return fn

    return make


def test_hook_failures_stay_with_their_row(spark):
    df = spark.createDataFrame([(i, "bad" if i == 3 else "ok", "t") for i in range(10)], "pair_id bigint, src string, tgt string")
    made = generate.with_candidates(df.coalesce(1), failing(), batch_size=4).orderBy("pair_id").collect()
    assert [r["pred1"] for r in made] == ["A"] * 3 + [None] + ["A"] * 6
    assert [r["gen_error"] for r in made] == [None] * 3 + ["RuntimeError: no"] + [None] * 6
    judged = preference.classify(generate.with_candidates(df, failing()), error="gen_error")
    assert judged.where(F.col("status") == "error").count() == 1


def test_hook_keeps_rows_without_source(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "pair_id bigint, src string")
    made = generate.with_candidates(df, generate.letter_editor).orderBy("pair_id").collect()
    assert [r["pred1"] for r in made] == [None, "a"]


def test_one_pass_gives_both_candidates(spark, physical):
    df = spark.createDataFrame([], "pair_id bigint, src string")
    assert physical(generate.with_candidates(df, generate.letter_editor)).count("MapInPandas") == 1


def test_limits_hold_the_distance(spark):
    random.seed(3)
    letters = "abcdeé日 X😀"

    def text(n: int) -> str:
        return "".join(random.choice(letters) for _ in range(n))

    rows = []
    for i in range(300):
        a = text(random.choice([1, 3, 20, 120]))
        at = random.randrange(len(a))
        rows.append((i, a, random.choice([a[:at] + text(3) + a[at + 1 :], text(len(a)), a[:at], a.replace("a", "ab")])))
    df = spark.createDataFrame(rows, "pair_id int, a string, b string").withColumn("_early", F.lit(None).cast("string"))
    df = df.unionByName(df.limit(2).withColumn("a", F.expr("CAST(X'C328E9FFFE41' AS STRING)")))
    limited = preference.add_limits(df, d=(F.col("a"), F.col("b")))
    got = preference.add_distance(limited, "d", F.col("a"), F.col("b")).withColumn("full", F.levenshtein("a", "b")).collect()
    assert all(r["d"] == r["full"] for r in got)
    limits = [r["d_limits"] for r in got]
    assert all(r["low"] <= g["d"] <= r["high"] for r, g in zip(limits, got))
    # Replaced characters need no table at all.
    assert any(r["low"] == r["high"] > 0 for r in limits) and any(r["low"] < r["high"] for r in limits)
