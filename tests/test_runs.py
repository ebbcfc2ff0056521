import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.operators import logs, rewards, runs
from pairforge.plans import grid, outcomes

RUN = (
    "experiment string, checkpoint_path string, cfg_method string, cfg_batch_size int, "
    "cfg_learning_rate double, cfg_num_epochs int, bleu_score double, train_loss double, "
    "eval_loss double, training_time double"
)


def table(spark, rows):
    return runs.results_table(spark.createDataFrame(rows, RUN))


def scored(spark, pairs):
    """Runs by name and score only."""
    return table(spark, [(n, f"e/{n}", None, None, None, None, s, 1.0, None, 60.0) for n, s in pairs])


def test_config_fills_what_the_name_leaves_open(spark):
    rows = [
        ("dpo_final_model_lr1e-07_ep1", "p", "dpo", 4, 1e-07, 1, 0.5, 0.7, 0.6, 120.0),
        ("mine", "p", "ipo", 8, 2e-06, None, None, None, None, None),
        ("other", "p", None, None, None, None, 0.1, 0.2, None, 30.0),
        (None, "p", "dpo", 4, 1e-07, 1, 0.9, 0.7, 0.6, 120.0),
    ]
    got = {r["experiment"]: r.asDict() for r in table(spark, rows).collect()}
    assert set(got) == {"dpo_final_model_lr1e-07_ep1", "mine", "other"}
    dpo, mine, other = (got[k] for k in ("dpo_final_model_lr1e-07_ep1", "mine", "other"))
    assert (dpo["base_method"], dpo["batch_size"], dpo["sft_lr"], dpo["final_lr"]) == ("dpo", 4, 1e-07, 1e-07)
    assert dpo["training_minutes"] == 2.0
    assert (mine["final_method"], mine["final_lr"], mine["epochs"], mine["bleu_score"]) == ("IPO", 2e-06, 1, 0.0)
    assert (other["final_method"], other["base_method"], other["final_lr"]) == ("SFT", None, None)


def test_ranking_and_ties(spark):
    t = scored(spark, [("sft_b_bs1_lr1e-5", 0.5), ("sft_a_bs1_lr1e-5", 0.5), ("dpo_x", 0.7), ("ipo_x", 0.1)])
    ranked = {r["experiment"]: r["rank"] for r in runs.ranked_runs(t).collect()}
    assert ranked == {"dpo_x": 1, "sft_a_bs1_lr1e-5": 2, "sft_b_bs1_lr1e-5": 3, "ipo_x": 4}
    assert runs.best_run(t).first()["experiment"] == "dpo_x"
    assert runs.best_run(t, "sft").first()["experiment"] == "sft_a_bs1_lr1e-5"
    assert runs.top_runs(t, 2).count() == 2
    assert [r["value"] for r in runs.in_order_of_appearance(t, "final_method").orderBy("place").collect()] == ["DPO", "SFT", "IPO"]
    assert {r["phase"]: r["experiment"] for r in runs.best_per_phase(t).collect()} == {"dpo": "dpo_x", "sft": "sft_a_bs1_lr1e-5"}
    passed = runs.with_best_path(spark.range(2), t, "sft").collect()
    assert {r["start_path"] for r in passed} == {"e/sft_a_bs1_lr1e-5"}


def test_no_runs(spark):
    t = table(spark, [])
    assert runs.best_run(t).collect() == []
    assert runs.summary(t).collect() == []
    assert runs.with_best_path(spark.range(1), t).first()["start_path"] is None
    with pytest.raises(ValueError):
        runs.in_phase(t, "x")


def test_summary(spark):
    scores = [0.1, 0.4, 0.35]
    t = scored(spark, [(f"sft_p_bs{i}_lr1e-5", s) for i, s in enumerate(scores)])
    row = runs.summary(t).first()
    assert (row["total_experiments"], row["best_bleu"], row["worst_bleu"]) == (3, 0.4, 0.1)
    assert math.isclose(row["std_bleu"], statistics.stdev(scores))
    assert (row["best_experiment"], row["total_training_time"]) == ("sft_p_bs1_lr1e-5", 3.0)
    assert runs.summary(scored(spark, [("dpo_x", 0.3)])).first()["std_bleu"] is None


def test_box_figures_against_numpy(spark):
    rng = np.random.default_rng(3)
    scores = {"dpo": rng.normal(0.5, 0.1, 37), "ipo": np.r_[rng.normal(0.4, 0.02, 20), 2.0, -1.0], "sft_p": [0.3]}
    pairs = [(f"{m}_{i}_bs1_lr1e-5", float(s)) for m, v in scores.items() for i, s in enumerate(v)]
    got = {r["final_method"]: r for r in runs.box_figures(scored(spark, pairs)).collect()}
    far = runs.box_outliers(scored(spark, pairs)).collect()
    for m, v in scores.items():
        r, v = got[m.split("_")[0].upper()], np.asarray(v, dtype=float)
        q1, med, q3 = np.percentile(v, [25, 50, 75])
        reach = 1.5 * (q3 - q1)
        near = v[(v >= q1 - reach) & (v <= q3 + reach)]
        want = (q1, med, q3, min(near.min(), q1), max(near.max(), q3))
        found = (r["q1"], r["median"], r["q3"], r["whisker_low"], r["whisker_high"])
        assert np.allclose(found, want, rtol=1e-12)
        assert r["n_outliers"] == len(v) - len(near)
    assert len(far) == sum(r["n_outliers"] for r in got.values())


def test_score_series_skip_unknown_rates(spark):
    t = scored(spark, [("dpo_x", 0.3), ("ipo_a_lr1e-7_ep1_lr3e-7", 0.4), ("sft_p_bs4_lr1e-5", 0.2)])
    got = {(r["kind"], r["series"], r["lr"]): r["mean_bleu"] for r in runs.score_by_rate(t).collect()}
    assert got == {("preference", "IPO", 3e-07): 0.4, ("SFT", "p", 1e-05): 0.2}


def test_grid(spark):
    plan = grid.grid(spark)
    rows = {r["experiment_name"]: r for r in plan.collect()}
    assert len(rows) == plan.count() == 28
    r = rows["sft_padding_bs128_lr8e-05_ep1"]
    assert (r["batch_size"], r["gradient_accumulation_steps"], r["effective_batch_size"]) == (32, 4, 128)
    assert (r["seed"], r["max_seq_length"], r["beta"]) == (42, 512, None)
    assert rows["ipo_final_model_lr1e-06_ep1"]["beta"] == 0.1
    ordered = [r["experiment_name"] for r in grid.in_category_order(plan).collect()]
    kinds = ("sft_padding", "sft_dataset_packing", "sft_batch_packing", "dpo", "ipo")
    assert ordered == [n for k in kinds for n in sorted(n for n in rows if k in n)]


def test_step_counts_and_log_steps(spark):
    plan = spark.createDataFrame([("a", 4, 4)], "experiment_name string, batch_size int, gradient_accumulation_steps int")
    counted = grid.step_counts(plan, F.lit(17_140))
    assert counted.select("micro_batches", "steps").first() == (4285, 1072)
    for block in (4, 4096):
        steps = grid.logged_steps(counted, block=block).orderBy("step").collect()
        assert [r["step"] for r in steps] == [1, *range(100, 1001, 100)]
        assert [r["evaluates"] for r in steps] == [False] + [True] * 10
        assert math.isclose(steps[1]["epoch"], 0.0933488914819, rel_tol=1e-9)


def test_plan_outcomes(spark):
    plan = spark.createDataFrame([("sft_a",), ("dpo_a",)], "experiment_name string")
    schema = "experiment_name string, run_id string, bleu_score double, final_loss double, eval_loss double"
    found = spark.createDataFrame([("sft_a", "1", 0.5, 1.0, None), ("sft_a", "2", 0.4, 1.0, 2.0), ("zzz", "3", 0.1, 1.0, 1.0)], schema)
    models = found.where("run_id = '2'").select("run_id").union(spark.createDataFrame([("dpo_a",)], "run_id string"))
    got = outcomes.plan_outcomes(plan, found, models)
    rows = {(r["experiment_name"], r["run_id"], r["training_completed"], r["has_final_model"]) for r in got.collect()}
    assert rows == {("sft_a", "1", True, False), ("sft_a", "2", True, True), ("dpo_a", None, False, True)}
    assert outcomes.plan_missing(plan, found).collect() == [("dpo_a",)]
    assert outcomes.plan_counts(got).first() == (3, 2, 1, 0, 2)


def test_last_eval_loss_skips_records_without_one(spark):
    rows = [("a", 1, 0.5), ("a", 2, 0.4), ("a", 3, None), ("b", 1, None)]
    df = spark.createDataFrame(rows, "run string, step int, eval_loss double")
    assert {r["run"]: r["eval_loss"] for r in logs.last_eval_loss(df, "run").collect()} == {"a": 0.4, "b": None}


def test_reward_losses(spark):
    schema = "policy_chosen double, ref_chosen double, policy_rejected double, ref_rejected double, n_chosen int, n_rejected int"
    # A log margin of -0.1104 gives an IPO loss of (h - 5)^2.
    df = spark.createDataFrame([(-1.1104, -1.0, -2.0, -2.0, 1, 1)], schema)
    ipo = rewards.pair_rewards(df, "ipo").first()
    assert math.isclose(ipo["margin"], -0.01104)
    assert math.isclose(ipo["loss"], (-0.1104 - 5) ** 2)
    dpo = rewards.pair_rewards(df).first()
    assert math.isclose(dpo["loss"], math.log(1 + math.exp(0.01104)))
    assert (dpo["accuracy"], ipo["accuracy"]) == (0.0, 0.0)
    far = spark.createDataFrame([(-1e6, 0.0, 0.0, -1e6, 1, 1)], schema)
    assert math.isclose(rewards.pair_rewards(far).first()["loss"], 2e5)
    with pytest.raises(ValueError):
        rewards.pair_rewards(df, "hinge")


def test_printed_scores_round_the_double(spark):
    from pairforge.functions.names import printed

    values = [1.25505, 1.00005, 0.12345, 2.00015, 0.0, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(printed(F.col("x"), ".4f")).collect()]
    assert got == [None if v is None else f"{v:.4f}" for v in values]
    java = [r[0] for r in df.select(F.format_string("%.4f", "x")).collect()]
    assert got[:-1] != java[:-1]
