"""Writing of preference sets, results, summaries and configs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pairforge.operators.position import with_position
from pairforge.operators.runs import in_order_of_appearance, ranked_runs, summary, summary_by_method
from pairforge.plans.grid import in_category_order
from pairforge.session import stored

SAMPLE = 100

# Column titles of the published table, and its order.
TITLES = {
    "experiment": "Experiment",
    "base_method": "Base Method",
    "batch_size": "Batch Size",
    "sft_lr": "SFT LR",
    "final_method": "Final Method",
    "final_lr": "Final LR",
    "epochs": "Epochs",
    "bleu_score": "BLEU Score",
    "train_loss": "Train Loss",
    "eval_loss": "Eval Loss",
    "training_minutes": "Training Time (min)",
    "checkpoint_path": "Checkpoint Path",
}
BLANKS = {"base_method": "unknown", "batch_size": "unknown", "sft_lr": "unknown", "final_lr": "-"}


def write_preferences(pairs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Save a preference set; mode ``append`` adds to a growing one."""
    pairs.write.mode(mode).parquet(path)


def write_preferences_json(pairs: DataFrame, path: str) -> None:
    pairs.select("prompt", "chosen", "rejected").write.mode("overwrite").json(path)


def numbered(pairs: DataFrame, key: str) -> DataFrame:
    """Saved pairs with ``entry_number`` from 0 in the order of their id."""
    return with_position(pairs, key, "entry_number").select(
        "entry_number", "prompt", "chosen", "rejected"
    )


def sample(pairs: DataFrame, key: str, n: int = SAMPLE) -> DataFrame:
    """The first records with their numbers, for a look by eye.

    Each task sorts out its own first ``n``, and only those are numbered.
    """
    first = pairs.orderBy(key).limit(n)
    number = F.row_number().over(Window.partitionBy().orderBy(key)) - 1
    return first.select(number.cast("bigint").alias("entry_number"), "prompt", "chosen", "rejected")


def write_numbered(numbered_pairs: DataFrame, path: str) -> None:
    numbered_pairs.write.mode("overwrite").json(path)


def write_results_csv(table: DataFrame, path: str) -> None:
    """The results table, best run first, with unknown fields spelled out."""
    shown = [
        F.coalesce(F.col(c).cast("string"), F.lit(BLANKS[c])).alias(t) if c in BLANKS
        else F.col(c).alias(t)
        for c, t in TITLES.items()
    ]
    ranked_runs(table).orderBy("rank").select(*shown).write.mode("overwrite").option(
        "header", True
    ).csv(path)


def read_results_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """The written table with the types of ``schema``."""
    raw = spark.read.option("header", True).csv(path)
    typed = [
        (F.nullif(F.col(t), F.lit(BLANKS[c])) if c in BLANKS else F.col(t))
        .cast(schema[c].dataType).alias(c)
        for c, t in TITLES.items()
    ]
    return raw.select(*[F.col(f"`{t}`").alias(t) for t in raw.columns]).select(*typed)


def summary_document(table: DataFrame) -> DataFrame:
    """One row with a JSON text: the summary, methods in order, method stats.

    There are three final methods at most, and base methods are names of
    training recipes, so both lists are small.
    """
    methods = in_order_of_appearance(table, "final_method")
    bases = in_order_of_appearance(table, "base_method")

    def listed(places: DataFrame):
        pairs = F.sort_array(F.collect_list(F.struct("place", "value")))
        return places.agg(F.transform(pairs, lambda p: p["value"]).alias("v")).scalar()

    stats = summary_by_method(table).agg(
        F.map_from_entries(
            F.collect_list(
                F.struct(
                    "final_method",
                    F.struct(F.col("n_runs").alias("count"), "best_bleu", "mean_bleu", "best_experiment"),
                )
            )
        ).alias("v")
    )
    whole = summary(table).withColumns(
        {
            "methods_tested": listed(methods),
            "base_methods_tested": listed(bases),
            "method_stats": stats.scalar(),
        }
    )
    return whole.select(F.to_json(F.struct("*")).alias("value"))


def write_summary(table: DataFrame, path: str) -> None:
    summary_document(table).write.mode("overwrite").text(path)


def write_files(rows: DataFrame, root: str, *order: str, path: str = "path", text: str = "text") -> DataFrame:
    """Text files of given names below ``root``; returns ``path, n_bytes`` of all.

    Rows of one path are the parts of one file, put together in ``order`` as
    they pass, so a file of any length is never held in memory. A file is
    written under a name of its own and moved when it is whole: a lost or
    repeated attempt leaves the same file and no reader sees half of one.
    Null texts are empty; a row without a path raises an error.
    """
    error = F.raise_error(F.lit("a file without a name")).cast("string")
    named = rows.withColumn("_path", F.coalesce(F.col(path), error))
    dealt = named.repartition("_path").sortWithinPartitions("_path", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root)
        attempt = uuid.uuid4().hex
        current, stream, n_bytes, made = None, None, 0, []

        def close() -> None:
            stream.close()
            files.move(f"{base}/{current}.{attempt}", f"{base}/{current}")
            made.append((current, n_bytes))

        for batch in batches:
            for name, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                if name != current:
                    if stream is not None:
                        close()
                    current, n_bytes = name, 0
                    files.create_dir(f"{base}/{name}".rpartition("/")[0], recursive=True)
                    stream = files.open_output_stream(f"{base}/{name}.{attempt}", compression=None)
                raw = (part.as_py() or "").encode()
                stream.write(raw)
                n_bytes += len(raw)
        if stream is not None:
            close()
        names = pa.array([n for n, _ in made], pa.string())
        yield pa.RecordBatch.from_arrays([names, pa.array([n for _, n in made], pa.int64())], ["path", "n_bytes"])

    return stored(dealt.select("_path", text).mapInArrow(run, "path string, n_bytes bigint"), "written")


def write_logs(logs: DataFrame, root: str, run: str = "experiment_name", order: str = "step") -> DataFrame:
    """One log per run, an array of records in ``order``; all other columns are
    the records' fields, and null fields are left out."""
    spec = Window.partitionBy(run).orderBy(order)
    fields = F.to_json(F.struct(*[F.col(f"`{c}`") for c in logs.columns if c not in (run, order) or c == "step"]))
    first, last = F.row_number().over(spec) == 1, F.lead(F.lit(1)).over(spec).isNull()
    part = F.concat(F.when(first, "[").otherwise(","), fields, F.when(last, "]\n").otherwise("\n"))
    parts = logs.select(F.concat(F.col(run), F.lit("/training_history.json")).alias("path"), F.col(order).alias("_at"), part.alias("text"))
    return write_files(parts, root, "_at")


def write_config_documents(plan: DataFrame, root: str, folder: str) -> DataFrame:
    """One document per row under the folder it names; fields without a value are null in it."""
    whole = F.to_json(F.struct(*[c for c in plan.columns if c != folder]), {"ignoreNullFields": "false"})
    return write_files(plan.select(F.concat(F.col(folder), F.lit("/training_config.json")).alias("path"), whole.alias("text")), root)


def write_configs(plan: DataFrame, root: str, *ties: str) -> None:
    """One config folder per planned run, and all of them in category order over
    the part files."""
    plan.write.mode("overwrite").partitionBy("experiment_name").json(f"{root}/runs")
    in_category_order(plan, *ties).write.mode("overwrite").json(f"{root}/all")
