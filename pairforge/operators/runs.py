"""Run analysis: results table, ranking, summaries and chart series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairforge.functions.names import is_preference_run, numeric_rate, parse_name, printed, rate_text, short_rate
from pairforge.operators.position import ranked
from pairforge.session import small_side


def results_table(runs: DataFrame) -> DataFrame:
    """Typed results, one row per run record.

    ``runs`` has ``experiment``, ``checkpoint_path``, the config fields
    ``cfg_method``, ``cfg_batch_size``, ``cfg_learning_rate``,
    ``cfg_num_epochs`` and the four metrics. The name is parsed first; the
    config fills what it leaves open. Unknown stays null here and is only
    rendered by the CSV sink.
    """
    p = F.col("_parsed")
    from_config = F.when(
        F.col("cfg_method").isin("dpo", "ipo"), F.upper("cfg_method")
    ).otherwise(F.lit("SFT"))
    final_method = F.coalesce(p["final_method"], from_config)
    fallback_lr = F.when(final_method.isin("DPO", "IPO"), F.col("cfg_learning_rate"))
    final_lr = F.coalesce(p["final_lr"], fallback_lr)
    return (
        runs.where(F.col("experiment").isNotNull())
        .withColumn("_parsed", parse_name(F.col("experiment")))
        .select(
            "experiment",
            F.coalesce(p["base_method"], "cfg_method").alias("base_method"),
            F.coalesce(p["batch_size"], "cfg_batch_size").cast("int").alias("batch_size"),
            F.coalesce(p["learning_rate"], "cfg_learning_rate").alias("sft_lr"),
            final_method.alias("final_method"),
            F.when(final_lr != 0, final_lr).alias("final_lr"),
            F.coalesce(p["epochs"], "cfg_num_epochs", F.lit(1)).cast("int").alias("epochs"),
            F.coalesce("bleu_score", F.lit(0.0)).alias("bleu_score"),
            F.coalesce("train_loss", F.lit(0.0)).alias("train_loss"),
            F.col("eval_loss"),
            (F.coalesce("training_time", F.lit(0.0)) / 60.0).alias("training_minutes"),
            "checkpoint_path",
        )
    )


def in_phase(table: DataFrame, phase: str = "all") -> DataFrame:
    """Runs of one phase, told by the prefix of the name."""
    preference = is_preference_run(F.col("experiment"))
    if phase == "sft":
        return table.where(~preference)
    if phase == "dpo":
        return table.where(preference)
    if phase == "all":
        return table
    raise ValueError(f"phase {phase!r} is none of sft, dpo, all")


def _order() -> list[Column]:
    return [F.desc("bleu_score"), F.asc("experiment")]


def ranked_runs(table: DataFrame) -> DataFrame:
    """Rank by score, best first; equal scores rank by name."""
    return ranked(table, _order())


def top_runs(table: DataFrame, n: int = 5) -> DataFrame:
    return table.orderBy(*_order()).limit(n)


def best_run(table: DataFrame, phase: str = "all") -> DataFrame:
    """The best run of a phase, or no row."""
    return top_runs(in_phase(table, phase), 1)


def best_per_phase(table: DataFrame) -> DataFrame:
    """The best run of each phase in one pass."""
    phase = F.when(is_preference_run(F.col("experiment")), "dpo").otherwise("sft")
    return table.groupBy(phase.alias("phase")).agg(*_best()).select("phase", "_best.*")


def _best() -> list[Column]:
    """First row in ranked order as a struct, by a partial aggregate."""
    row = F.struct("bleu_score", "experiment")
    return [F.min_by(row, F.struct(-F.col("bleu_score"), F.col("experiment"))).alias("_best")]


def with_best_path(next_phase: DataFrame, table: DataFrame, phase: str = "sft") -> DataFrame:
    """Hand the best run's checkpoint path to every row of the next phase."""
    path = best_run(table, phase).select("checkpoint_path")
    return next_phase.withColumn("start_path", path.scalar())


def display_row(table: DataFrame) -> DataFrame:
    """The printed form of the top list."""
    return table.select(
        "final_method", "base_method",
        F.coalesce(F.col("batch_size").cast("string"), F.lit("-")).alias("batch_size"),
        short_rate(F.col("sft_lr")).alias("sft_lr"),
        rate_text(F.col("final_lr")).alias("final_lr"),
        printed(F.col("bleu_score"), ".4f").alias("bleu"),
    )


def summary(table: DataFrame) -> DataFrame:
    """Count, score range, mean, sample deviation, minutes and best run."""
    return table.agg(
        F.count(F.lit(1)).alias("total_experiments"),
        F.max("bleu_score").alias("best_bleu"),
        F.min("bleu_score").alias("worst_bleu"),
        F.avg("bleu_score").alias("mean_bleu"),
        F.when(F.count(F.lit(1)) > 1, F.stddev_samp("bleu_score")).alias("std_bleu"),
        F.sum("training_minutes").alias("total_training_time"),
        *_best(),
    ).where("total_experiments > 0").select(
        "*", F.col("_best.experiment").alias("best_experiment")
    ).drop("_best")


def summary_by_method(table: DataFrame) -> DataFrame:
    return table.groupBy("final_method").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.max("bleu_score").alias("best_bleu"),
        F.avg("bleu_score").alias("mean_bleu"),
        *_best(),
    ).select(
        "final_method", "n_runs", "best_bleu", "mean_bleu",
        F.col("_best.experiment").alias("best_experiment"),
    )


def in_order_of_appearance(table: DataFrame, column: str) -> DataFrame:
    """Distinct values in the order in which the ranked table shows them."""
    first = table.groupBy(F.col(column).alias("value")).agg(*_best()).select(
        "value", "_best.*"
    )
    return ranked(first, _order(), name="place").select("value", "place")


def box_figures(
    table: DataFrame, by: str = "final_method", value: str = "bleu_score", tie: str = "experiment"
) -> DataFrame:
    """Quartiles (linear interpolation), whiskers and outlier count per group.

    Quartiles are read off exact ranks, so no group is held in one task.
    """
    figures, _ = _box(table, by, value, tie)
    return figures


def box_outliers(
    table: DataFrame, by: str = "final_method", value: str = "bleu_score", tie: str = "experiment"
) -> DataFrame:
    """The rows beyond the whiskers."""
    figures, rows = _box(table, by, value, tie)
    ends = small_side(figures.select(by, "whisker_low", "whisker_high"), "whiskers")
    return rows.join(ends, by).where(
        (F.col(value) < F.col("whisker_low")) | (F.col(value) > F.col("whisker_high"))
    ).select(by, tie, value)


def _box(table: DataFrame, by: str, value: str, tie: str) -> tuple[DataFrame, DataFrame]:
    rows = ranked(
        table.select(by, value, tie), [F.col(by), F.col(value), F.col(tie)], name="_at", start=0
    )
    size = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"),
        F.min(value).alias("low"), F.max(value).alias("high"),
    )
    placed = rows.join(small_side(size, "sizes"), by).withColumn("_at", F.col("_at") - F.col("_first"))

    def at(rank: Column) -> Column:
        return F.max(F.when(F.col("_at") == rank, F.col(value)))

    steps, ends = [], {}
    for name, share in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        spot = (F.col("n") - 1) * F.lit(share)
        steps += [at(F.floor(spot)).alias(f"{name}_lo"), at(F.ceil(spot)).alias(f"{name}_hi")]
        below, above = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        ends[name] = below + (above - below) * (spot - F.floor(spot))
    quartiles = (
        placed.groupBy(by, "n", "low", "high").agg(*steps)
        .withColumns(ends).select(by, "n", "low", "high", *ends)
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = placed.select(by, value).join(small_side(quartiles, "quartiles"), by)
    near = (F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach)
    figures = inside.groupBy(by, "n", "low", "high", "q1", "median", "q3").agg(
        F.least("q1", F.min(F.when(near, F.col(value)))).alias("whisker_low"),
        F.greatest("q3", F.max(F.when(near, F.col(value)))).alias("whisker_high"),
        F.count_if(~near).alias("n_outliers"),
    )
    return figures, rows


def score_by_batch(table: DataFrame) -> DataFrame:
    """Series of the batch chart: SFT runs by base method and batch size."""
    return _series(table.where(F.col("final_method") == "SFT"), "base_method", F.col("batch_size"), "batch_size")


def score_by_rate(table: DataFrame) -> DataFrame:
    """Series of the rate chart: SFT by base method, DPO and IPO by method."""
    sft = _series(table.where(F.col("final_method") == "SFT"), "base_method", F.col("sft_lr"), "lr")
    rate = numeric_rate(F.col("final_lr"))
    preference = table.where(F.col("final_method").isin("DPO", "IPO") & rate.isNotNull())
    both = sft.withColumn("kind", F.lit("SFT")).unionByName(
        _series(preference, "final_method", rate, "lr").withColumn("kind", F.lit("preference"))
    )
    return both.withColumn("log10_lr", F.log10("lr"))


def _series(table: DataFrame, by: str, x: Column, name: str) -> DataFrame:
    return table.groupBy(F.col(by).alias("series"), x.alias(name)).agg(
        F.avg("bleu_score").alias("mean_bleu"),
        F.max("bleu_score").alias("best_bleu"),
        F.count(F.lit(1)).alias("n_runs"),
    )
