"""The plan joined to what came of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairforge.session import small_side

OUTCOMES = ["bleu_score", "final_loss", "eval_loss"]


def plan_outcomes(plan: DataFrame, runs: DataFrame, final_models: DataFrame | None = None) -> DataFrame:
    """Every planned run with its outcomes, or with nulls if it has none.

    ``runs`` has ``experiment_name``, ``run_id`` and the outcomes; there may be
    very many runs of one name. A plan that is counted small is broadcast, so
    the runs are not shuffled and a frequent name is no hot spot; planned runs
    without outcome come from a second, aggregated branch. ``final_models`` has
    the folders with a model as ``run_id``; a folder without a record is named
    after the planned run, and has a model though it was not completed.
    """
    planned = small_side(plan, "plan")
    found = runs.join(planned, "experiment_name")
    models = None
    if final_models is not None:
        models = final_models.select("run_id").distinct().withColumn("_model", F.lit(True))
        found = found.join(models, "run_id", "left").withColumn(
            "has_final_model", F.coalesce("_model", F.lit(False))
        ).drop("_model")
    else:
        found = found.withColumn("has_final_model", F.lit(False))
    found = found.withColumn("training_completed", F.lit(True))
    missing = plan_missing(plan, runs)
    if models is not None:
        missing = missing.join(models.withColumnRenamed("run_id", "experiment_name"), "experiment_name", "left")
    else:
        missing = missing.withColumn("_model", F.lit(False))
    missing = missing.withColumn("has_final_model", F.coalesce("_model", F.lit(False))).drop("_model").withColumns(
        {c: F.lit(None).cast(runs.schema[c].dataType) for c in ("run_id", *OUTCOMES)}
        | {"training_completed": F.lit(False)}
    )
    return found.unionByName(missing)


def plan_missing(plan: DataFrame, runs: DataFrame) -> DataFrame:
    """Planned runs that no record or folder was found for."""
    planned = small_side(plan.select("experiment_name"), "planned-names")
    names = runs.select("experiment_name").join(planned, "experiment_name", "left_semi").distinct()
    return plan.join(names, "experiment_name", "left_anti")


def plan_counts(outcomes: DataFrame) -> DataFrame:
    """Run counts by kind, told by substring, and how many were completed."""

    def having(part: str):
        return F.count_if(F.col("experiment_name").contains(part))

    return outcomes.agg(
        F.count(F.lit(1)).alias("total"),
        having("sft").alias("sft"),
        having("dpo").alias("dpo"),
        having("ipo").alias("ipo"),
        F.count_if("training_completed").alias("completed"),
    )
