"""Run records, training logs, best-run pointer and artifact listing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairforge.operators.logs import log_kind
from pairforge.session import small_side

CONFIG = (
    "method string, batch_size int, learning_rate double, num_epochs int, beta double, "
    "gradient_accumulation_steps int, warmup_ratio double, weight_decay double, "
    "max_seq_length int, max_length int, max_prompt_length int, seed int, "
    "model_name string, sft_model_path string, gradient_checkpointing boolean, "
    "flash_attention_2 boolean"
)
METRICS = (
    "bleu_score double, train_loss double, eval_loss double, training_time double, "
    "train_samples bigint, eval_samples bigint, test_samples bigint"
)
SYSTEM = (
    "gpu string, cuda_version string, pytorch_version string, spark_version string, "
    "timestamp string"
)
RECORD = f"experiment_name string, config struct<{CONFIG}>, metrics struct<{METRICS}>, system struct<{SYSTEM}>"

_METRIC_KEYS = [
    "rewards/chosen", "rewards/rejected", "rewards/accuracies", "rewards/margins",
    "logps/chosen", "logps/rejected", "logits/chosen", "logits/rejected",
]
_LOG_KEYS = (
    ["loss", "grad_norm", "learning_rate", "epoch", "eval_loss", "eval_runtime",
     "eval_samples_per_second", "eval_steps_per_second", "train_runtime",
     "train_samples_per_second", "train_steps_per_second", "total_flos", "train_loss"]
    + _METRIC_KEYS + [f"eval_{k}" for k in _METRIC_KEYS]
)
LOG = ", ".join(f"`{k}` double" for k in _LOG_KEYS) + ", step bigint"


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def _last_part(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"^experiment_name=", "")


#: Files and bytes that a task reads before it passes them on.
READ_FILES = 1024
READ_BYTES = 1 << 24


def _dealt(written: DataFrame, root: str) -> DataFrame:
    """Whole names of written files, dealt out to the tasks that open them."""
    return written.select(F.concat(F.lit(f"{root.rstrip('/')}/"), "path").alias("path")).repartition("path")


def file_texts(written: DataFrame, root: str) -> DataFrame:
    """``path, value`` of the files that ``write_files`` returned, each opened by a task.

    The driver sees no name and a file is no split of its own, so very many
    small files cost what it takes to open them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(root)
        names, texts, size = [], [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open_input_stream(name if "://" not in name else fs.FileSystem.from_uri(name)[1], compression=None) as f:
                    texts.append(f.read())
                names.append(name)
                size += len(texts[-1])
                if len(names) >= READ_FILES or size >= READ_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(texts, pa.binary())], ["path", "value"])
                    names, texts, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], ["path", "value"])

    found = _dealt(written, root).mapInArrow(run, "path string, value binary")
    return found.select("path", F.col("value").cast("string").alias("value"))


def file_sizes(written: DataFrame, root: str) -> DataFrame:
    """``path, length`` of those written files that are there, looked up by tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            names = batch.column(0).to_pylist()
            found = files.get_file_info([n if "://" not in n else fs.FileSystem.from_uri(n)[1] for n in names])
            there = [(n, i.size) for n, i in zip(names, found) if i.type == fs.FileType.File]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in there], pa.string()), pa.array([k for _, k in there], pa.int64())], ["path", "length"]
            )

    return _dealt(written, root).mapInArrow(run, "path string, length bigint")


def _texts(spark: SparkSession, path: str, written: DataFrame | None, whole: bool = True) -> DataFrame:
    """``_file, value`` of the files of a pattern, or of written files below a folder."""
    if written is not None:
        return file_texts(written, path).withColumnRenamed("path", "_file")
    return spark.read.text(path, wholetext=whole).select(F.col("_metadata.file_path").alias("_file"), "value")


def read_records(spark: SparkSession, path: str, lines: bool = False, written: DataFrame | None = None) -> DataFrame:
    """Run records with run name, folder and, for a broken one, its text.

    ``path`` is a pattern such as ``<dir>/*/results.json`` with one document
    per file, which is named after its folder, or with ``lines`` a folder of
    JSON lines, where a record's own name goes first. Files are read as text
    and parsed, so a broken record is an ordinary value that can be counted.
    A pattern is listed by the driver; with ``written``, what ``write_files``
    returned, ``path`` is its folder and nothing is listed.
    """
    raw = _texts(spark, path, written, not lines).where(F.btrim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    folder = _folder(F.col("_file"))
    parsed = raw.select(folder.alias("experiment_dir"), F.from_json("value", f"{RECORD}, _bad string", options).alias("r"))
    name = _last_part(F.col("experiment_dir"))
    return parsed.select(
        (F.coalesce("r.experiment_name", name) if lines else name).alias("experiment_name"),
        "experiment_dir", "r.config", "r.metrics", "r.system", "r._bad",
    )


def good_records(records: DataFrame) -> DataFrame:
    return records.where(F.col("_bad").isNull()).drop("_bad")


def bad_records(records: DataFrame) -> DataFrame:
    """The side table of files that are no records."""
    return records.where(F.col("_bad").isNotNull()).select(
        "experiment_name", "experiment_dir", F.col("_bad").alias("content")
    )


def runs_of(records: DataFrame) -> DataFrame:
    """Flat run rows, the input of the results table."""
    return records.select(
        F.col("experiment_name").alias("experiment"),
        F.col("experiment_dir").alias("checkpoint_path"),
        F.col("config.method").alias("cfg_method"),
        F.col("config.batch_size").alias("cfg_batch_size"),
        F.col("config.learning_rate").alias("cfg_learning_rate"),
        F.col("config.num_epochs").alias("cfg_num_epochs"),
        "metrics.bleu_score", "metrics.train_loss", "metrics.eval_loss", "metrics.training_time",
    )


def log_documents(spark: SparkSession, path: str, written: DataFrame | None = None) -> DataFrame:
    """Training logs, one row per file: run, folder, records, and the text of a broken one.

    A log is an array of records of three kinds. Files are read as text, many
    small ones by one task, and parsed into wide records, so that a broken log
    is a row that can be counted and not a failed job. A blank file is broken.
    ``path`` and ``written`` are those of ``read_records``.
    """
    raw = _texts(spark, path, written)
    folder = _folder(F.col("_file"))
    parsed = raw.select(
        _last_part(folder).alias("experiment_name"), folder.alias("experiment_dir"),
        F.from_json("value", f"array<struct<{LOG}>>", {"mode": "PERMISSIVE"}).alias("records"), "value",
    )
    return parsed.select(
        "experiment_name", "experiment_dir", "records", F.when(F.col("records").isNull(), F.col("value")).alias("_bad")
    )


def log_rows(documents: DataFrame) -> DataFrame:
    """One row per record with its place in the log; slashes in names become underscores."""
    rows = documents.select("experiment_name", F.posexplode("records").alias("place", "r"))
    values = {k: F.col(f"r.`{k}`") for k in _LOG_KEYS}
    return rows.select(
        "experiment_name", "place", log_kind(values["eval_loss"], values["loss"], values["train_runtime"]).alias("kind"),
        "r.step", *[v.alias(k.replace("/", "_")) for k, v in values.items()],
    )


def bad_logs(documents: DataFrame) -> DataFrame:
    """The side table of files that are no logs."""
    return bad_records(documents)


def read_logs(spark: SparkSession, path: str, written: DataFrame | None = None) -> DataFrame:
    """The records of all logs that can be parsed."""
    return log_rows(log_documents(spark, path, written))


def read_configs(spark: SparkSession, path: str, schema: str, written: DataFrame | None = None) -> DataFrame:
    """Whole config documents, one per file, with the folder each lies in."""
    raw = _texts(spark, path, written)
    name = _last_part(_folder(F.col("_file")))
    return raw.select(name.alias("folder"), F.from_json("value", schema).alias("c")).select("folder", "c.*")


def write_records(records: DataFrame, path: str) -> None:
    """Append run records as JSON lines; adds the system facts if missing."""
    if "system" not in records.columns:
        records = records.withColumn(
            "system",
            F.struct(
                F.version().alias("spark_version"),
                F.current_timestamp().cast("string").alias("timestamp"),
            ),
        )
    records.write.mode("append").json(path)


def preference_record(
    report: DataFrame, seconds: float, settings: list[dict], model_path: str, dataset: str,
    batch_size: int, min_gap: int, max_ratio: float, min_ratio: float, seed: int = 42,
) -> DataFrame:
    """The record of a preference build, from the one row of its outcome report."""

    def struct(values: dict) -> Column:
        return F.struct(*[F.lit(v).alias(k) for k, v in values.items()])

    counters = [
        "total_processed", "successful", "skipped_identical", "skipped_empty",
        "skipped_small_diff", "skipped_length_ratio", "total_chosen_dist", "total_rejected_dist",
    ]
    filters = {
        "min_edit_distance_diff": min_gap, "max_length_ratio": max_ratio, "min_length_ratio": min_ratio
    }
    generation = [struct(s).alias(f"config_{i}") for i, s in enumerate(settings, 1)]
    config = F.struct(
        F.lit(model_path).alias("sft_model_path"), F.lit(dataset).alias("dataset_name"),
        F.lit(batch_size).alias("batch_size"), F.struct(*generation).alias("generation_configs"),
        struct(filters).alias("filtering"), F.lit(seed).alias("seed"),
    )
    metrics = F.struct(
        F.col("successful").alias("final_dataset_size"),
        F.lit(float(seconds)).alias("processing_time"), *counters,
    )
    return report.select(config.alias("config"), metrics.alias("metrics"))


def write_pointer(best: DataFrame, path: str) -> None:
    """One JSON row with the best run's path and the time."""
    best.select(
        F.col("checkpoint_path").alias("best_model_path"),
        F.current_timestamp().cast("string").alias("timestamp"),
    ).write.mode("overwrite").json(path)


def read_pointer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        F.get_json_object("value", "$.best_model_path").alias("best_model_path")
    )


# Files that are published per run, and inside its model folder.
RUN_FILES = ["results.json", "training_config.json", "training_history.json", "README.md"]
MODEL_FILES = [
    "config.json", "tokenizer_config.json", "tokenizer.json", "vocab.json", "merges.txt",
    "special_tokens_map.json", "generation_config.json", "added_tokens.json",
]


def artifacts(
    spark: SparkSession, root: str, run_files: list[str] | None = RUN_FILES,
    model_files: list[str] | None = MODEL_FILES,
) -> DataFrame:
    """Files below ``root/<run>/`` by name, or all for None; contents are not read."""

    def listed(names: list[str] | None) -> Column:
        return F.lit(True) if names is None else name.isin(names)

    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        .select("path", "length")
    )
    parts = F.split("path", "/")
    name, parent = F.element_at(parts, -1), F.element_at(parts, -2)
    in_model = parent == "final_model"
    run = F.when(in_model, F.element_at(parts, -3)).otherwise(parent)
    wanted = F.when(in_model, listed(model_files)).otherwise(listed(run_files))
    return files.where(wanted).select(_last_part(run).alias("run"), name.alias("file"), in_model.alias("in_model"), "length")


def files_below(spark: SparkSession, root: str, written: DataFrame | None = None) -> DataFrame:
    """All files in ``<root>/<top>/<run>/`` and their model folders, without reading any.

    The driver lists the folder, or with ``written``, what ``write_files``
    returned, tasks look up those files and the driver sees none.
    """
    if written is not None:
        files = file_sizes(written, root)
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    parts = F.split("path", "/")
    in_model = F.element_at(parts, -2) == "final_model"

    def above(n: int) -> Column:
        return F.when(in_model, F.element_at(parts, -n - 1)).otherwise(F.element_at(parts, -n))

    return files.select(
        above(3).alias("top"), _last_part(above(2)).alias("run"), F.element_at(parts, -1).alias("file"),
        in_model.alias("in_model"), "length",
    )


def allow_list(spark: SparkSession, run_files: list[str] = RUN_FILES, model_files: list[str] = MODEL_FILES) -> DataFrame:
    """The files that are published, as a table to join or to extend."""
    rows = [(False, f) for f in run_files] + [(True, f) for f in model_files]
    return spark.createDataFrame(rows, "in_model boolean, file string")


def allowed(listing: DataFrame, names: DataFrame) -> DataFrame:
    """The listed files that the table of names has."""
    return listing.join(small_side(names.distinct(), "allow-list"), ["in_model", "file"], "left_semi").select(*listing.columns)


def sizes_by(listing: DataFrame, *by: str) -> DataFrame:
    return listing.groupBy(*by).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("total_bytes"))


def artifact_sizes(listing: DataFrame) -> DataFrame:
    return listing.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("total_bytes")
    )


def final_models(listing: DataFrame) -> DataFrame:
    """Runs that have a model folder."""
    return listing.where("in_model").select("run").distinct()
