"""Training logs: last evaluation loss and learning curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def log_kind(eval_loss: Column, loss: Column, runtime: Column) -> Column:
    """The kind of a log record, told by the column that is set."""
    return (
        F.when(eval_loss.isNotNull(), "eval")
        .when(loss.isNotNull(), "train")
        .when(runtime.isNotNull(), "final")
    )


def last_eval_loss(logs: DataFrame, *run: str, order: str = "step") -> DataFrame:
    """The evaluation loss of the last record that has one; null if none has."""
    last = F.max_by("eval_loss", F.when(F.col("eval_loss").isNotNull(), F.col(order)))
    return logs.groupBy(*run).agg(last.alias("eval_loss"))


def learning_curve(
    logs: DataFrame, *run: str, step: str = "step", metric: str = "loss"
) -> DataFrame:
    """A training metric and its ``eval_`` twin by step, one row per run and step."""

    def mean(kind: str, value: str) -> Column:
        return F.avg(F.when(F.col("kind") == kind, F.col(value)))

    return logs.where(F.col("kind").isin("train", "eval")).groupBy(*run, step).agg(
        mean("train", metric).alias("train"), mean("eval", f"eval_{metric}").alias("eval")
    )
