"""The experiment grid and the steps each run takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairforge.functions.names import preference_name, sft_name

# The published grid. Batch sizes are (per step, accumulation).
PADDING = {
    "type": "sft", "method": "padding", "rates": ["5e-05", "8e-05"],
    "batches": [(8, 1), (16, 1), (32, 1), (32, 2), (32, 4)],
}
PACKING = {
    "type": "sft", "method": "packing", "rates": ["3e-05", "5e-05"],
    "batches": [(4, 1), (8, 1), (16, 1)],
}
PREFERENCE = {"rates": ["1e-07", "3e-07", "1e-06"], "batches": [(16, 1)], "beta": 0.1}
FAMILIES = [
    PADDING,
    PACKING | {"method": "dataset_packing"},
    PACKING | {"method": "batch_packing"},
    PREFERENCE | {"type": "dpo", "method": "dpo"},
    PREFERENCE | {"type": "ipo", "method": "ipo"},
]
COMMON = {
    "model_name": "HuggingFaceTB/SmolLM-135M",
    "optimizer": "adamw_torch",
    "weight_decay": 0.01,
    "warmup_ratio": 0.1,
    "max_seq_length": 512,
    "seed": 42,
}
START_MODEL = "final_model"
CATEGORIES = ["sft_padding", "sft_dataset_packing", "sft_batch_packing", "dpo", "ipo"]


def effective_batch(batch: Column, accumulation: Column, given: Column | None = None) -> Column:
    product = batch * accumulation
    return product if given is None else F.coalesce(given, product)


def _family(spark: SparkSession, spec: dict) -> DataFrame:
    """Every batch size with every rate of one family."""
    batches = F.array(
        *[F.struct(F.lit(b).alias("batch_size"), F.lit(a).alias("gradient_accumulation_steps"))
          for b, a in spec["batches"]]
    )
    rates = F.array(*[F.lit(r) for r in spec["rates"]])
    return (
        spark.range(1)
        .select(F.explode(batches).alias("b"))
        .select("b.*", F.explode(rates).alias("lr_text"))
        .withColumns(
            {
                "training_type": F.lit(spec["type"]),
                "method": F.lit(spec["method"]),
                "num_epochs": F.lit(1),
                "beta": F.lit(spec.get("beta")).cast("double"),
            }
        )
    )


def grid(spark: SparkSession, families: list[dict] = FAMILIES, common: dict = COMMON) -> DataFrame:
    """One row per planned run, with its name and the shared settings."""
    plan = _family(spark, families[0])
    for spec in families[1:]:
        plan = plan.unionByName(_family(spark, spec))
    effective = effective_batch(F.col("batch_size"), F.col("gradient_accumulation_steps"))
    name = F.when(
        F.col("training_type") == "sft",
        sft_name(F.col("method"), effective, F.col("lr_text"), F.col("num_epochs")),
    ).otherwise(
        preference_name(F.col("method"), F.lit(START_MODEL), F.col("lr_text"), F.col("num_epochs"))
    )
    return plan.withColumns(
        {
            "learning_rate": F.col("lr_text").cast("double"),
            "effective_batch_size": effective,
            "experiment_name": name,
        }
        | {k: F.lit(v) for k, v in common.items()}
    )


def category_rank(name: Column) -> Column:
    """Place of a run's category, found by substring; null for none."""
    rank = F.when(name.contains(CATEGORIES[0]), 0)
    for i, category in enumerate(CATEGORIES[1:], 1):
        rank = rank.when(name.contains(category), i)
    return rank


def in_category_order(plan: DataFrame, *ties: str) -> DataFrame:
    """Category by category and by name; runs of no category are left out.

    ``ties`` order rows of one name, and let the sort split a frequent one.
    """
    ranked = plan.withColumn("category_rank", category_rank(F.col("experiment_name")))
    return ranked.where(F.col("category_rank").isNotNull()).orderBy("category_rank", "experiment_name", *ties)


def step_counts(plan: DataFrame, rows: Column) -> DataFrame:
    """Micro-batches and optimizer steps of each run over ``rows`` rows."""
    micro = F.ceil(rows / F.col("batch_size"))
    return plan.withColumn("micro_batches", micro).withColumn(
        "steps", F.ceil(F.col("micro_batches") / F.col("gradient_accumulation_steps"))
    )


def logged_steps(counted: DataFrame, every: int = 100, block: int = 4096) -> DataFrame:
    """The steps at which a run logs and evaluates, with the epoch reached.

    Steps are made block by block, so that a long run is neither one array
    nor one task.
    """
    last = F.floor(F.col("steps") / every)
    blocks = counted.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / block))))
    spread = blocks.repartition("experiment_name", "_block")
    first = F.col("_block") * block
    marks = spread.withColumn(
        "_mark", F.explode(F.sequence(first, F.least(first + (block - 1), last)))
    )
    # Mark 0 stands for step 1, which is logged but not evaluated.
    step = F.when(F.col("_mark") == 0, F.lit(1).cast("bigint")).otherwise(F.col("_mark") * every)
    return (
        marks.withColumn("step", step)
        .where(F.col("step") <= F.col("steps"))
        .withColumn("evaluates", F.col("step") % every == 0)
        .withColumn(
            "epoch", F.col("step") * F.col("gradient_accumulation_steps") / F.col("micro_batches")
        )
        .drop("_block", "_mark")
    )
