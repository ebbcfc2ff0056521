"""A preference build that can stop and go on, and its progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pairforge.operators.position import running_totals
from pairforge.operators.preference import KEPT, classify, kept_pairs, outcome_counts


STATUSES = ["error", "empty", "identical", "small_diff", "length_ratio", KEPT]
COUNTS = "status string, n bigint, chosen_dist bigint, rejected_dist bigint"


def candidate_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """Candidate files as they arrive."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


def append_judged(
    candidates: DataFrame, path: str, checkpoint: str, *keys: str, **rules
) -> StreamingQuery:
    """Judge all new candidate files and append the rows, in folders by status.

    The rules hold no state, so a restart goes on with the first micro-batch
    that was not committed, and no row is written twice. Every micro-batch is
    a snapshot of the build.
    """
    judged = classify(candidates, **rules).select(
        *keys, "src", "chosen", "rejected", "chosen_dist", "rejected_dist", "status"
    )
    return (
        judged.writeStream.format("parquet").outputMode("append").partitionBy("status")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def build_by_batch(
    candidates: DataFrame, path: str, checkpoint: str, *keys: str, **rules
) -> StreamingQuery:
    """Judge new candidate files; every micro-batch leaves its rows and its counts.

    Both lie in a folder named after the batch and are overwritten if the batch
    runs again, so a restart neither loses nor repeats any. The counts are
    observed while the rows are written, so no row is read again, and progress
    is a sum over counts: its cost does not grow with the rows judged before.
    The counts are written last; they are the manifest of finished versions.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        rows = classify(batch, **rules).select(
            *keys, "src", "chosen", "rejected", "chosen_dist", "rejected_dist", "status"
        )
        seen = Observation()

        def total(status: str, column: str) -> Column:
            value = F.when((F.col("status") == status) & F.lit(status == KEPT), F.col(column))
            return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

        metrics = [F.count_if(F.col("status") == s).alias(f"{s}:n") for s in STATUSES]
        metrics += [total(s, c).alias(f"{s}:{c}") for s in STATUSES for c in ("chosen_dist", "rejected_dist")]
        rows.observe(seen, *metrics).write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        found = [
            (s, *(seen.get[f"{s}:{c}"] for c in ("n", "chosen_dist", "rejected_dist"))) for s in STATUSES
        ]
        counts = batch.sparkSession.createDataFrame(found, COUNTS).coalesce(1)
        counts.write.mode("overwrite").parquet(f"{path}/counts/batch={batch_id}")

    return (
        candidates.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def batch_counts(spark: SparkSession, path: str) -> DataFrame:
    """Outcome counts of each finished batch."""
    return spark.read.parquet(f"{path}/counts")


def progress_by_batch(spark: SparkSession, path: str) -> DataFrame:
    """Rows judged and kept up to and with each batch, and the success rate so far."""
    per_batch = batch_counts(spark, path).groupBy(F.col("batch").cast("bigint").alias("batch_id")).agg(
        F.sum(F.when(F.col("status") != "error", F.col("n")).otherwise(0)).alias("n_seen"),
        F.sum(F.when(F.col("status") == KEPT, F.col("n")).otherwise(0)).alias("n_kept"),
    )
    so_far = running_totals(per_batch, "batch_id", {"processed": F.col("n_seen"), "successful": F.col("n_kept")})
    rate = F.when(F.col("processed") > 0, 100.0 * F.col("successful") / F.col("processed")).otherwise(F.lit(0.0))
    return so_far.select("batch_id", "processed", "successful", rate.alias("success_rate"))


def snapshot(spark: SparkSession, path: str, version: int) -> DataFrame:
    """All rows judged up to and with batch ``version``, also while the build goes on.

    Only finished batches count, so a batch that is being written, or written
    again, is not seen; later batches' folders are not read at all.
    """
    last = batch_counts(spark, path).agg(F.max(F.col("batch").cast("bigint"))).first()[0]
    upto = min(version, -1 if last is None else last)
    return spark.read.parquet(f"{path}/rows").where(F.col("batch") <= upto).drop("batch")


def version_at(spark: SparkSession, path: str, processed: int) -> int:
    """The last version with at most so many processed rows; -1 for none."""
    upto = progress_by_batch(spark, path).where(F.col("processed") <= processed)
    found = upto.agg(F.max("batch_id")).first()[0]
    return -1 if found is None else found


def judged_so_far(spark: SparkSession, path: str) -> DataFrame:
    """All committed rows, also while the build runs."""
    return spark.read.parquet(path)


def pairs_so_far(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The kept pairs; only their folder is read."""
    return kept_pairs(judged_so_far(spark, path), *keys)


def progress(spark: SparkSession, path: str) -> DataFrame:
    """Outcome counts of the committed rows; texts are not read."""
    return outcome_counts(judged_so_far(spark, path))
