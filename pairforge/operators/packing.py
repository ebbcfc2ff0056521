"""Batches, labels and packed sequences of token ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairforge.functions.text import PAD_ID, SEP_ID
from pairforge.operators.position import prefix_sums, ranked
from pairforge.operators.tokens import last_place
from pairforge.session import stored

IGNORED = -100
MULTIPLE = 8


def left_pad(
    batched: DataFrame, pad_id: int | Column = PAD_ID, ids: str = "ids", batch: str = "batch_id"
) -> DataFrame:
    """Pad every row on the left to the longest row of its batch, with mask."""
    # A batch has a fixed number of rows, so this window is bounded.
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    pad = F.lit(pad_id) if isinstance(pad_id, int) else pad_id
    kind = batched.schema[ids].dataType.elementType
    gap = F.col("_longest") - F.size(ids)
    return batched.withColumn("_longest", longest).select(
        *[c for c in batched.columns if c != ids],
        F.concat(F.array_repeat(pad.cast(kind), gap), F.col(ids)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(0), gap), F.array_repeat(F.lit(1), F.size(ids))).alias("attention_mask"),
    )


def completion_labels(
    ids: Column, sep_id: int | Column = SEP_ID, pad_id: int | Column = PAD_ID, which: str = "last"
) -> Column:
    """Labels of the completion only; a row without separator has none."""
    sep = F.lit(sep_id) if isinstance(sep_id, int) else sep_id
    pad = F.lit(pad_id) if isinstance(pad_id, int) else pad_id
    if which == "last":
        place = last_place(ids, sep)
    elif which == "first":
        found = F.array_position(ids, sep).cast("int")
        place = F.when(found == 0, F.size(ids)).otherwise(found)
    else:
        raise ValueError(f"which {which!r} is neither last nor first")

    def label(x: Column, i: Column) -> Column:
        return F.when((i < place) | (x == pad), F.lit(IGNORED).cast("bigint")).otherwise(x.cast("bigint"))

    return F.transform(ids, label)


def flatten_batches(
    batched: DataFrame, order: str, ids: str = "ids", batch: str = "batch_id",
    first_label: int | None = IGNORED,
) -> DataFrame:
    """All rows of a batch in one flat row without padding.

    Positions restart at 0 for each sequence, ``cu_seqlens`` holds the borders
    and the first label of each sequence is masked. A batch has a fixed number
    of rows, so the collected group is bounded.
    """
    rows = F.transform(
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(ids).alias("x")))),
        lambda r: r["x"],
    )

    def positions(x: Column) -> Column:
        return F.transform(x, lambda _, i: i)

    def labels(x: Column) -> Column:
        if first_label is None:
            return x
        return F.transform(x, lambda v, i: F.when(i == 0, F.lit(first_label).cast("bigint")).otherwise(v))

    def ends(x: Column) -> Column:
        start = F.array(F.lit(0))
        return F.aggregate(
            x, start, lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) + F.size(r)))
        )

    return batched.groupBy(batch).agg(rows.alias("_rows")).select(
        batch,
        F.flatten("_rows").alias("input_ids"),
        F.flatten(F.transform("_rows", positions)).alias("position_ids"),
        F.flatten(F.transform("_rows", labels)).alias("labels"),
        ends(F.col("_rows")).alias("cu_seqlens"),
    )


def pad_to_multiple(ids: Column, pad_id: int | Column = PAD_ID, multiple: int = MULTIPLE) -> Column:
    pad = F.lit(pad_id) if isinstance(pad_id, int) else pad_id
    return F.concat(ids, F.array_repeat(pad.cast("bigint"), F.pmod(-F.size(ids), F.lit(multiple))))


def pack_wrapped(df: DataFrame, key: str, ids: str = "ids", limit: int = 256) -> DataFrame:
    """Join all sequences in key order and cut the result every ``limit`` tokens.

    Running lengths give each row its offset; rows are cut at the chunk
    borders where they lie, and only the pieces travel to their chunk. The
    borders of the sequences and restarting positions are kept.
    """
    filled = df.where(F.size(ids) > 0).select(key, ids, F.size(ids).alias("_n"))
    laid = prefix_sums(filled, key, {"_from": F.col("_n")})
    begin, end = F.col("_from"), F.col("_from") + F.col("_n")

    def piece(chunk: Column) -> Column:
        start = F.greatest(chunk * limit, begin)
        skip = (start - begin).cast("int")
        size = (F.least((chunk + 1) * limit, end) - start).cast("int")
        return F.struct(
            chunk.alias("chunk"), start.alias("start"), F.col(key).alias("id"), skip.alias("skip"),
            F.slice(F.col(ids), skip + 1, size).alias("ids"),
        )

    # Pieces are cut before they are exploded: a long row is not copied per chunk.
    chunks = F.sequence(F.floor(begin / limit), F.floor((end - 1) / limit))
    cut = laid.select(F.explode_outer(F.transform(chunks, piece)).alias("piece")).select(
        "piece.chunk", "piece"
    )
    # A chunk has at most ``limit`` tokens, so at most ``limit`` pieces.
    grouped = cut.groupBy("chunk").agg(F.sort_array(F.collect_list("piece")).alias("_p"))
    return grouped.select(
        "chunk",
        F.flatten(F.transform("_p", lambda p: p["ids"])).alias("input_ids"),
        F.flatten(
            F.transform("_p", lambda p: F.transform(p["ids"], lambda _, i: i + p["skip"]))
        ).alias("position_ids"),
        F.transform("_p", lambda p: p["id"]).alias("sequences"),
        F.transform("_p", lambda p: F.size(p["ids"])).alias("lengths"),
    )


def best_fit_plan(counts: dict[int, int], limit: int) -> tuple[list[tuple[int, list[tuple[int, int, int]]]], int]:
    """Best fit decreasing on counted lengths, and the number of bins.

    Takes the longest first, each into the fullest bin with room. Bins of equal
    content are one group, and each length splits at most one group and opens
    at most two, so the plan grows with ``limit`` and not with the pieces. For
    each length it has runs ``(first rank, pieces per bin, first bin)``.
    """
    groups: list[tuple[int, int, int]] = []  # room, first bin, bins
    n_bins = 0
    plan = []
    for length in sorted(counts, reverse=True):
        left, rank, runs = counts[length], 0, []
        kept = []
        for room, first, bins in sorted(groups):
            fit = room // length
            if not left or not fit:
                kept.append((room, first, bins))
                continue
            whole = min(bins, left // fit)
            if whole:
                runs.append((rank, fit, first))
                kept.append((room - fit * length, first, whole))
                rank, left = rank + whole * fit, left - whole * fit
            if whole < bins:
                # Fewer pieces are left than a bin takes.
                if left:
                    runs.append((rank, left, first + whole))
                    kept.append((room - left * length, first + whole, 1))
                    rank, left, whole = rank + left, 0, whole + 1
                if whole < bins:
                    kept.append((room, first + whole, bins - whole))
        groups = kept
        fit = limit // length
        for take, bins in ((fit, left // fit), (left % fit, 1)):
            if take and bins:
                runs.append((rank, take, n_bins))
                groups.append((limit - take * length, n_bins, bins))
                rank, n_bins = rank + take * bins, n_bins + bins
        plan.append((length, runs))
    return plan, n_bins


def pack_best_fit(df: DataFrame, key: str, ids: str = "ids", limit: int = 256) -> DataFrame:
    """Pack whole sequences into bins of ``limit`` tokens, best fit decreasing.

    Sequences over the limit are first cut into pieces; a full piece is a bin
    of its own, named after its sequence. The others are counted by length, at
    most ``limit`` numbers, from which the bins of all of them follow. A piece
    finds its bin by its rank among those of its length, in key order, so the
    result does not depend on the table's size or layout. Equal or null keys
    are pieces like any other.
    """
    spark = df.sparkSession
    starts = F.sequence(F.lit(1), F.size(ids), F.lit(limit))
    pieces = df.where(F.size(ids) > 0).select(
        key, F.posexplode_outer(F.transform(starts, lambda i: F.slice(ids, i, limit))).alias("piece", "_ids")
    ).withColumn("n", F.size("_ids"))
    full = pieces.where(F.col("n") == limit).select(
        F.concat_ws("-", F.lit("full"), F.col(key).cast("string"), F.col("piece").cast("string")).alias("bin_id"),
        F.array(F.struct(F.col(key).alias("id"), "piece", F.col("_ids").alias("ids"))).alias("_p"),
    )
    laid = stored(
        ranked(pieces.where(F.col("n") < limit), [F.col("n"), F.col(key), F.col("piece")], "_rank", 0), "short-pieces"
    )
    # One row for each length below the limit.
    counts = {r["n"]: r["k"] for r in laid.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    plan, _ = best_fit_plan(counts, limit)
    before = {n: sum(k for m, k in counts.items() if m < n) for n in counts}
    runs = spark.createDataFrame(
        [(n, before[n], own) for n, own in plan],
        "n int, _before bigint, _runs array<struct<rank:bigint,take:bigint,bin:bigint>>",
    )
    rank = F.col("_rank") - F.col("_before")
    placed = laid.join(F.broadcast(runs), "n").withColumn(
        "_run", F.element_at(F.filter("_runs", lambda r: r["rank"] <= rank), -1)
    )
    bin_ = F.col("_run.bin") + F.floor((rank - F.col("_run.rank")) / F.col("_run.take"))
    shared = (
        placed.select(
            F.concat(F.lit("bin-"), bin_.cast("string")).alias("bin_id"),
            F.struct(F.col(key).alias("id"), "piece", F.col("_ids").alias("ids")).alias("_one"),
        )
        # Pieces are not empty, so a bin has at most ``limit`` of them.
        .groupBy("bin_id").agg(F.sort_array(F.collect_list("_one")).alias("_p"))
    )
    return shared.unionByName(full).select(
        "bin_id",
        F.flatten(F.transform("_p", lambda p: p["ids"])).alias("input_ids"),
        F.flatten(F.transform("_p", lambda p: F.transform(p["ids"], lambda _, i: i))).alias("position_ids"),
        F.transform("_p", lambda p: p["id"]).alias("sequences"),
        F.transform("_p", lambda p: F.size(p["ids"])).alias("lengths"),
    )
