"""Corpus BLEU without smoothing, overall, by group and running.

The texts never move. Where they are scanned, each row is reduced to ten counts:
its words get numbers, an n-gram is the number of the shorter run before it and
of one more word, numbered again, so every key has one fixed width and no n-gram
is ever built as a string or a row. Only the counts are summed across tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pairforge.functions.words import MAX_N, split_words
from pairforge.operators.arrow import map_batches, slices
from pairforge.operators.position import running_totals, with_position
from pairforge.session import stored

ORDERS = range(1, MAX_N + 1)
COUNTS = [f"match{n}" for n in ORDERS] + [f"total{n}" for n in ORDERS] + ["pred_len", "ref_len"]


def _numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of all texts, equal for equal words, and its text."""
    flat, of_text = split_words(texts)
    return flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), of_text


def _highest(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, each with its highest count."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.maximum.reduceat(counts, first)


def text_counts(pred: pa.Array, refs: pa.Array) -> list[np.ndarray]:
    """``COUNTS`` of each row; ``refs`` has a list of texts per row."""
    n = len(pred)
    n_refs = pc.fill_null(pc.list_value_length(refs), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    every = pa.concat_arrays([pred.cast(pa.large_string()), refs.flatten().cast(pa.large_string())])
    row_of = np.r_[np.arange(n), np.repeat(np.arange(n), n_refs)]
    word, of_text = _numbered(every)
    lengths = np.bincount(of_text, minlength=len(every))
    shortest = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(shortest, row_of[n:], lengths[n:])
    matches, totals = [], []
    gram, n_words = word, int(word.max(initial=-1)) + 1
    for order in ORDERS:
        if order > 1:
            whole = of_text[: max(len(of_text) - order + 1, 0)] == of_text[order - 1 :]
            # The shorter runs, cut to those one more word of the text follows.
            longer = gram[: len(whole)] * n_words + word[order - 1 :]
            gram = np.full(len(whole), -1)
            gram[whole] = np.unique(longer[whole], return_inverse=True)[1]
        at = np.flatnonzero(gram >= 0)
        kinds = int(gram.max(initial=-1)) + 1
        keys, times = np.unique(of_text[at] * kinds + gram[at], return_counts=True)
        text, kind = np.divmod(keys, max(kinds, 1))
        own = text < n
        row_keys = row_of[text] * kinds + kind
        wanted, most = _highest(row_keys[~own], times[~own])
        place = np.searchsorted(wanted, row_keys[own])
        there = place < len(wanted)
        there[there] = wanted[place[there]] == row_keys[own][there]
        shared = np.minimum(times[own][there], most[place[there]])
        matches.append(np.bincount(text[own][there], weights=shared, minlength=n).astype(np.int64))
        totals.append(np.maximum(lengths[:n] - order + 1, 0))
    return [*matches, *totals, lengths[:n], np.where(n_refs > 0, shortest, 0)]


def row_counts(
    df: DataFrame, key: str, prediction: str, reference: str, carry: list[str] = ()
) -> DataFrame:
    """Per row: clipped matches and possible matches for n = 1 to 4, and lengths.

    ``reference`` is a string, or an array of strings of which the highest
    count and the shortest length are taken. Texts without any word have zeros.
    """
    keys = [key, *carry]
    several = df.schema[reference].dataType.typeName() == "array"
    refs = F.col(reference) if several else F.array(reference)
    texts = df.select(*keys, F.col(prediction).alias("_p"), refs.alias("_r"))

    def make():
        def each(batch: pa.RecordBatch):
            pred, refs_ = batch.column(len(keys)), batch.column(len(keys) + 1)
            inside = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(refs_.flatten()), 0).to_numpy(zero_copy_only=False))]
            ends = np.cumsum(pc.fill_null(pc.list_value_length(refs_), 0).to_numpy(zero_copy_only=False))
            sizes = np.diff(inside[np.r_[0, ends]].astype(np.int64))
            sizes = sizes + pc.fill_null(pc.binary_length(pred), 0).to_numpy(zero_copy_only=False)
            for at, n in slices(sizes):
                kept = [batch.column(i).slice(at, n) for i in range(len(keys))]
                yield kept + text_counts(pred.slice(at, n), refs_.slice(at, n))

        return each

    fields = [df.schema[k] for k in keys] + [T.StructField(c, T.LongType()) for c in COUNTS]
    return map_batches(texts, make, T.StructType(fields))


def score() -> Column:
    """BLEU from the summed counts; 0 if any order has no match."""
    precisions = [
        F.when(F.col(f"total{n}") > 0, F.col(f"match{n}").cast("double") / F.col(f"total{n}"))
        .otherwise(F.lit(0.0))
        for n in ORDERS
    ]
    mean = sum((F.ln(p) for p in precisions[1:]), F.ln(precisions[0])) / MAX_N
    brevity = F.when(F.col("pred_len") > F.col("ref_len"), F.lit(1.0)).otherwise(
        F.exp(1.0 - F.col("ref_len").cast("double") / F.col("pred_len"))
    )
    usable = (F.col("pred_len") > 0) & (F.least(*precisions) > 0)
    return F.when(usable, F.exp(mean) * brevity).otherwise(F.lit(0.0))


def corpus_bleu(
    df: DataFrame, key: str, prediction: str, reference: str, by: list[str] = ()
) -> DataFrame:
    """One row of summed counts and ``bleu`` per group, or for the whole table."""
    rows = row_counts(df, key, prediction, reference, by)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]
    return rows.groupBy(*by).agg(*sums).withColumn("bleu", score())


def running_bleu(
    df: DataFrame, key: str, prediction: str, reference: str, every: int = 100
) -> DataFrame:
    """BLEU of all rows so far after each full block of ``every`` rows.

    ``key`` is a unique integer in dataset order. The counts of the rows are
    written, numbered by the key and summed by block; texts are read once.
    """
    counted = stored(row_counts(df, key, prediction, reference), "row-counts")
    block = F.floor(F.col("_pos") / every)
    blocks = (
        with_position(counted, key, "_pos")
        .groupBy(block.alias("block"))
        .agg(F.count(F.lit(1)).alias("in_block"), *[F.sum(c).alias(f"_{c}") for c in COUNTS])
    )
    totals = running_totals(
        blocks, "block", {"rows_done": F.col("in_block")} | {c: F.col(f"_{c}") for c in COUNTS}
    )
    return totals.where(F.col("in_block") == every).select(
        "rows_done", *COUNTS, score().alias("bleu")
    )


def with_targets(predictions: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Targets with their predictions by row id.

    A target without a prediction has an empty one, so its length counts.
    """
    own = [c for c in predictions.columns if c != key]
    texts = [c for c in own if predictions.schema[c].dataType.simpleString() == "string"]
    return targets.join(predictions, key, "left").fillna("", subset=texts).select(
        key, *own, *[c for c in targets.columns if c != key]
    )
