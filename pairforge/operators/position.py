"""Row positions, running totals, batches, splits and ranks.

No window here sees a whole table. Two ways, by kind of order:

* ``prefix_sums`` orders by a unique integer key. Rows are grouped by the upper
  bits of the key, so one group holds at most ``2**12`` rows whatever the data.
  The group totals are written and counted: up to ``2**18`` are summed up in
  one window and broadcast, more are grouped by their own upper bits first.
* ``ranked`` orders by any columns. Spark's range exchange balances them, also
  if one leading value holds a third of the rows, as the tie-breaker is part of
  the range key. The laid out rows are written before they are counted, so
  that a lost executor cannot change a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairforge.session import stored

ROW_BITS = 12
TOTAL_BITS = 18


def _required(key: str, value: Column) -> Column:
    """``value``, or an error where the key is null."""
    error = F.raise_error(F.lit(f"{key} is null")).cast("bigint")
    return F.when(F.col(key).isNull(), error).otherwise(value)


def _before(partition: str | None, order: str):
    spec = Window.partitionBy(partition) if partition else Window.partitionBy()
    return spec.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _starts(totals: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Sum of all earlier rows of a stored table, for every key."""

    def earlier(partition: str | None) -> list[Column]:
        w = _before(partition, key)
        return [F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in names]

    bound = 1 << TOTAL_BITS
    if totals.limit(bound + 1).count() <= bound:
        return F.broadcast(totals.select(key, *earlier(None)))
    upper = f"{key}_"
    grouped = totals.withColumn(upper, F.shiftright(key, TOTAL_BITS))
    sums = stored(grouped.groupBy(upper).agg(*[F.sum(n).alias(n) for n in names]), "totals")
    above = _starts(sums, upper, names).select(upper, *[F.col(n).alias(f"{n}_above") for n in names])
    inside = grouped.select(upper, key, *earlier(upper))
    return inside.join(above, upper).select(
        key, *[(F.col(n) + F.col(f"{n}_above")).alias(n) for n in names]
    )


def prefix_sums(df: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """Add, in the order of ``key``, the totals of ``sums`` over all earlier rows.

    ``key`` must be a unique integer column without nulls; a null or repeated
    key raises an error. The table is read twice: once for the group totals,
    with the columns of ``sums`` only.
    """
    names = list(sums)
    data = df.withColumns(
        {"_bucket": _required(key, F.shiftright(F.col(key).cast("bigint"), ROW_BITS))}
        | {f"_v_{n}": sums[n].cast("bigint") for n in names}
    )
    totals = data.groupBy("_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    starts = _starts(stored(totals, "totals"), "_bucket", [f"_t_{n}" for n in names])
    w = _before("_bucket", key)
    repeated = F.lag(key).over(Window.partitionBy("_bucket").orderBy(key)) == F.col(key)
    error = F.raise_error(F.concat(F.lit(f"{key} repeats: "), F.col(key).cast("string"))).cast("bigint")
    local = data.withColumns(
        {"_again": F.coalesce(repeated, F.lit(False))}
        | {f"_l_{n}": F.coalesce(F.sum(f"_v_{n}").over(w), F.lit(0)) for n in names}
    )
    kept = [c for c in df.columns if c not in names]
    return local.join(starts, "_bucket").select(
        *kept, *[F.when(F.col("_again"), error).otherwise(F.col(f"_t_{n}") + F.col(f"_l_{n}")).alias(n) for n in names]
    )


def running_totals(blocks: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """Totals up to and with each row of a table of numbered blocks.

    The blocks are written first, as the rows behind them should be read once.
    """
    names = list(sums)
    kept = stored(blocks.withColumns({f"_v_{n}": v.cast("bigint") for n, v in sums.items()}), "blocks")
    values = kept.select(key, *[F.coalesce(f"_v_{n}", F.lit(0)).alias(f"_b_{n}") for n in names])
    before = _starts(values, key, [f"_b_{n}" for n in names])
    return kept.join(before, key).select(
        *blocks.columns, *[(F.col(f"_b_{n}") + F.coalesce(f"_v_{n}", F.lit(0))).alias(n) for n in names]
    )


def with_position(df: DataFrame, key: str, name: str = "pos") -> DataFrame:
    """Row position from 0 in the order of a unique integer key."""
    return prefix_sums(df, key, {name: F.lit(1)})


def with_batch(df: DataFrame, key: str, size: int) -> DataFrame:
    """Position and number of the fixed-size batch; the last may be short."""
    return with_position(df, key).withColumn("batch_id", F.floor(F.col("pos") / size))


def split_by_position(df: DataFrame, key: str, share: float = 0.9) -> DataFrame:
    """The first ``int(share * N)`` rows are ``train``, the others ``eval``."""
    n = df.agg(F.count(F.lit(1)).alias("n")).select(
        F.floor(F.lit(float(share)) * F.col("n")).alias("cut")
    )
    return with_position(df, key).withColumn(
        "part", F.when(F.col("pos") < n.scalar(), "train").otherwise("eval")
    )


def ranked(
    df: DataFrame, order: list[Column], name: str = "rank", start: int = 1,
    partitions: int | None = None,
) -> DataFrame:
    """Number the rows in any order; ``order`` should end in a tie-breaker."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = stored(
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id()),
        "ranked",
    ).withColumn("_part", F.shiftright("_slot", 33))
    # One row per partition, so at most ``n`` rows are ordered and broadcast.
    starts = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select(
        "_part", F.coalesce(F.sum("_n").over(_before(None, "_part")), F.lit(0)).alias("_start")
    )
    inside = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    return laid.join(F.broadcast(starts), "_part").select(
        *df.columns, (F.col("_start") + inside + F.lit(start)).cast("bigint").alias(name)
    )


def shuffle_key(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A repeatable random order, with the position in it."""
    keyed = df.withColumn("_mixed", shuffle_key(key, seed))
    return ranked(keyed, [F.col("_mixed"), F.col(key)], name="pos", start=0).drop("_mixed")
