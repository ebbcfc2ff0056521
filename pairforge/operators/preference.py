"""Preference pairs from two candidates and a target, with every drop counted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pairforge.functions.text import length_ratio
from pairforge.operators.arrow import slices
from pairforge.operators.position import running_totals, with_batch
from pairforge.session import balanced

# Defaults of the published build.
MIN_GAP = 2
MAX_RATIO = 3.0
MIN_RATIO = 0.33

KEPT = "kept"
# Bounds that are tried, as multiples of the least possible distance.
BANDS = (1, 3, 12)
LEAST_BAND = 16
KINDS = 64


def prefer(pred1: Column, pred2: Column, dist1: Column, dist2: Column) -> Column:
    """The closer candidate is chosen; on a tie it is the second."""

    def ordered(a: Column, b: Column, da: Column, db: Column) -> Column:
        return F.struct(
            a.alias("chosen"), b.alias("rejected"),
            da.alias("chosen_dist"), db.alias("rejected_dist"),
        )

    return F.when(dist1 < dist2, ordered(pred1, pred2, dist1, dist2)).otherwise(
        ordered(pred2, pred1, dist2, dist1)
    )


def _codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts as numbers, and how many each has; -1 for one that is no UTF-8."""
    parts, sizes = [], []
    for t in texts:
        try:
            parts.append(t.decode().encode("utf-32-le"))
            sizes.append(len(parts[-1]) // 4)
        except UnicodeDecodeError:
            sizes.append(-1)
    return np.frombuffer(b"".join(parts), np.uint32), np.array(sizes, np.int64)


def _limits(first: list[bytes], second: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Limits of the edit distance of each two texts that cost one look at each character.

    Low: characters of one text that the other has not, counted by kind, as
    every edit mends at most one on each side. High: places that differ when
    the texts are laid side by side, and what one is longer.
    """
    codes, sizes = zip(_codes(first), _codes(second))
    lengths = [np.maximum(n, 0) for n in sizes]
    starts = [np.cumsum(n) - n for n in lengths]
    rows = np.arange(len(first))
    counts = [
        np.bincount(np.repeat(rows, n) * KINDS + c % KINDS, minlength=len(rows) * KINDS).reshape(-1, KINDS)
        for c, n in zip(codes, lengths)
    ]
    more = counts[0] - counts[1]
    low = np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1))
    both = np.minimum(*lengths)
    of_row = np.repeat(rows, both)
    at = np.arange(len(of_row)) - np.repeat(np.cumsum(both) - both, both)
    apart = codes[0][starts[0][of_row] + at] != codes[1][starts[1][of_row] + at]
    high = np.bincount(of_row[apart], minlength=len(rows)) + np.maximum(*lengths) - both
    bad = (sizes[0] < 0) | (sizes[1] < 0)
    n_bytes = [max(len(a), len(b)) for a, b in zip(first, second)]
    return np.where(bad, 0, low), np.where(bad, n_bytes, high)


@F.pandas_udf(T.StructType([T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType())]))
def distance_limits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for a, b in batches:
        first, second = ([t if t is not None else b"" for t in x] for x in (a, b))
        sizes = np.array([len(x) + len(y) for x, y in zip(first, second)], np.int64)
        found = [_limits(first[at : at + n], second[at : at + n]) for at, n in slices(sizes)]
        low, high = (np.concatenate([f[i] for f in found] or [[]]).astype(np.int32) for i in (0, 1))
        yield pd.DataFrame({"low": low, "high": high})


def add_limits(df: DataFrame, **texts: tuple[Column, Column]) -> DataFrame:
    """For each name its column ``<name>_limits``, of the rows that ``_early`` leaves open."""

    def open_text(x: Column) -> Column:
        return F.when(F.col("_early").isNull(), x).cast("binary")

    return df.withColumns({f"{n}_limits": distance_limits(open_text(a), open_text(b)) for n, (a, b) in texts.items()})


def add_distance(df: DataFrame, name: str, a: Column, b: Column) -> DataFrame:
    """Exact edit distance in characters of rows with ``add_limits``.

    Where the limits meet they are the distance. Otherwise the bounded form works on a band of the table of both texts and gives -1
    above its bound, so bands from the lower limit on are tried, and the last
    is the upper limit, which cannot be exceeded.
    """
    low, high = F.col(f"{name}_limits.low"), F.col(f"{name}_limits.high")
    found = F.when(low == high, low)
    for i, times in enumerate([*BANDS, None]):
        wide = F.greatest(low.cast("bigint") * times, F.lit(LEAST_BAND * times)) if times else high
        bound = F.least(wide, high).cast("int")
        unknown = F.col("_early").isNull() & F.coalesce(found < 0, F.lit(True))
        column = f"{name}_{i}" if times else name
        df = df.withColumn(column, F.when(unknown, F.call_function("levenshtein", a, b, bound)).otherwise(found))
        found = F.col(column)
    return df


def classify(
    df: DataFrame, min_gap: int = MIN_GAP, max_ratio: float = MAX_RATIO,
    min_ratio: float = MIN_RATIO, source: str = "src", target: str = "tgt",
    pred1: str = "pred1", pred2: str = "pred2", error: str | None = None,
    spread_by: str | None = None,
) -> DataFrame:
    """Add ``status``, ``chosen``, ``rejected`` and both distances.

    The first rule that applies names the status, so each row is counted once.
    Distances are only worked out where the cheap rules leave the row open.
    They cost far more than moving the texts, so with ``spread_by``, a unique
    key, rows are dealt out evenly to all tasks first; it pays where files are
    few or long texts lie together.
    """
    if spread_by:
        df = balanced(df, spread_by)
    p1, p2, tgt = F.col(pred1), F.col(pred2), F.col(target)
    broken = F.col(source).isNull() | tgt.isNull()
    if error:
        broken = broken | F.col(error).isNotNull()
    early = (
        F.when(broken, "error")
        .when((F.coalesce(p1, F.lit("")) == "") | (F.coalesce(p2, F.lit("")) == ""), "empty")
        .when(p1 == p2, "identical")
    )
    open_rows = df.withColumn("_early", early)
    # Limits of both come first: a Python step between would repeat the bands.
    limited = add_limits(open_rows, _d1=(p1, tgt), _d2=(p2, tgt))
    measured = add_distance(add_distance(limited, "_d1", p1, tgt), "_d2", p2, tgt)
    d1, d2 = F.col("_d1"), F.col("_d2")
    first = d1 < d2
    ratio = F.when(first, length_ratio(p1, p2)).otherwise(length_ratio(p2, p1))
    status = (
        F.when(F.col("_early").isNotNull(), F.col("_early"))
        .when(F.abs(d1 - d2) < min_gap, "small_diff")
        .when((ratio > max_ratio) | (ratio < min_ratio), "length_ratio")
        .otherwise(KEPT)
    )
    pick = F.when(F.col("_early").isNull(), prefer(p1, p2, d1, d2))
    # A generated row keeps later filters on the status above this point. Were
    # they pushed down, each would work out both distances once more.
    judged = measured.select(
        *df.columns, F.inline(F.array(F.struct(status.alias("status"), pick.alias("_pick"))))
    )
    return judged.select(*df.columns, "status", "_pick.*")


def kept_pairs(classified: DataFrame, *keys: str, source: str = "src") -> DataFrame:
    """Prompt, chosen and rejected of the kept rows; the prompt is the bare source."""
    return classified.where(F.col("status") == KEPT).select(
        *keys, F.col(source).alias("prompt"), "chosen", "rejected"
    )


def failed_rows(classified: DataFrame) -> DataFrame:
    """The side table of rows that could not be judged."""
    return classified.where(F.col("status") == "error")


def outcome_counts(classified: DataFrame) -> DataFrame:
    """One row per status with row count and distance sums of the kept rows."""
    kept = F.col("status") == KEPT
    return classified.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.when(kept, F.col("chosen_dist"))), F.lit(0)).cast("bigint").alias("chosen_dist"),
        F.coalesce(F.sum(F.when(kept, F.col("rejected_dist"))), F.lit(0)).cast("bigint").alias("rejected_dist"),
    )


def outcome_report(classified: DataFrame) -> DataFrame:
    """The eight counters with means and success rate, in one row."""
    kept = F.col("status") == KEPT

    def rows(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    def distance(name: str) -> Column:
        return F.coalesce(F.sum(F.when(kept, F.col(name))), F.lit(0)).cast("bigint")

    total = F.count_if(F.col("status") != "error")
    return classified.agg(
        total.alias("total_processed"),
        rows(KEPT).alias("successful"),
        rows("identical").alias("skipped_identical"),
        rows("empty").alias("skipped_empty"),
        rows("small_diff").alias("skipped_small_diff"),
        rows("length_ratio").alias("skipped_length_ratio"),
        distance("chosen_dist").alias("total_chosen_dist"),
        distance("rejected_dist").alias("total_rejected_dist"),
        F.avg(F.when(kept, F.col("chosen_dist"))).alias("mean_chosen_dist"),
        F.avg(F.when(kept, F.col("rejected_dist"))).alias("mean_rejected_dist"),
        F.when(rows(KEPT) > 0, 100.0 * rows(KEPT) / total).alias("success_rate"),
    )


def running_success(
    candidates: DataFrame, key: str, batch_size: int = 128, every: int = 20, **rules
) -> DataFrame:
    """Success rate so far after every ``every``-th batch, the first one excepted.

    Batches are numbered by the key alone and meet the status of each row, so
    the texts are not moved for it.
    """
    batches = with_batch(candidates.select(key), key, batch_size).select(key, "batch_id")
    judged = classify(candidates, **rules).select(key, "status")
    return success_so_far(judged.join(batches, key), every)


def success_so_far(judged: DataFrame, every: int = 20) -> DataFrame:
    """Running counts over judged rows with a ``batch_id``."""
    per_batch = judged.groupBy("batch_id").agg(
        F.count_if(F.col("status") != "error").alias("n_seen"),
        F.count_if(F.col("status") == KEPT).alias("n_kept"),
    )
    so_far = running_totals(
        per_batch, "batch_id", {"processed": F.col("n_seen"), "successful": F.col("n_kept")}
    )
    return so_far.where((F.col("batch_id") % every == 0) & (F.col("batch_id") > 0)).select(
        "batch_id", "processed", "successful",
        F.when(F.col("processed") > 0, 100.0 * F.col("successful") / F.col("processed"))
        .otherwise(F.lit(0.0)).alias("success_rate"),
    )
