"""Vocabulary, token ids and truncation."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pairforge.functions.text import EOS, PAD, SEP, SEP_ID
from pairforge.functions.words import split_words
from pairforge.operators.arrow import SLICE, map_batches, slices
from pairforge.operators.position import ranked
from pairforge.session import stored

# Frequent tokens that are broadcast: at most HEAD rows of at most HEAD_BYTES
# bytes, so at most some 40 MB whatever the corpus.
HEAD = 1 << 19
HEAD_BYTES = 64
# Bytes of words that are looked up together, and what a word takes besides its text.
LOOK_UP = 8 * SLICE
WORD_BYTES = 16

# Published limits.
MAX_TOKENS = 256
MAX_PROMPT = 128


def add_words(df: DataFrame, text: str, specials: Sequence[str] = (), name: str = "tokens") -> DataFrame:
    """Replace the column ``text`` by the list of its words.

    Special tokens stay whole, and the text on either side of one is split by
    itself. Rows stay where they are; a null text has no words.
    """
    place = df.columns.index(text)
    marks = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None

    def make():
        def each(batch: pa.RecordBatch):
            sizes = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False)
            for at, n in slices(sizes):
                some = batch.slice(at, n)
                parts, of_row, whole = some.column(place), np.arange(n), None
                if marks:
                    cut = [marks.split(t or "") for t in parts.to_pylist()]
                    parts = pa.array([p for c in cut for p in c], pa.large_string())
                    of_row = np.repeat(of_row, [len(c) for c in cut])
                    whole = np.concatenate([np.arange(len(c)) % 2 == 1 for c in cut])
                flat, of_part = split_words(parts, whole)
                ends = np.r_[0, np.cumsum(np.bincount(of_row[of_part], minlength=n))].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), flat.cast(pa.string()))
                yield [lists if i == place else some.column(i) for i in range(some.num_columns)]

        return each

    words = T.StructField(name, T.ArrayType(T.StringType()))
    return map_batches(df, make, T.StructType([words if f.name == text else f for f in df.schema.fields]))


def vocabulary(tokens: DataFrame, column: str = "tokens") -> DataFrame:
    """Ids from 0 by falling frequency, then by token, of an array column."""
    # The outer form, as for the plain one Spark filters empty arrays first and
    # works out the words once more to do so.
    counts = (
        tokens.select(F.explode_outer(column).alias("token"))
        .where(F.col("token").isNotNull())
        .groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    )
    return ranked(counts, [F.desc("n"), F.col("token")], name="token_id", start=0)


def with_specials(
    vocab: DataFrame, eos: str = EOS, pad: str | None = None, sep: str = SEP
) -> DataFrame:
    """Append the special tokens that are missing: end, pad, separator.

    Without a pad token, or with one that also ends texts, ``[PAD]`` is added.
    """
    specials = [eos, PAD if pad in (None, eos) else pad, sep]
    present = F.collect_set(F.when(F.col("token").isin(specials), F.col("token")))
    state = vocab.agg(
        F.coalesce(F.max("token_id"), F.lit(-1)).alias("last"), present.alias("present")
    )
    wanted = F.array(*[F.lit(s) for s in specials])
    missing = state.select(
        "last", F.posexplode(F.array_except(wanted, F.col("present"))).alias("at", "token")
    )
    return vocab.select("token", "token_id").unionByName(
        missing.select("token", (F.col("last") + 1 + F.col("at")).cast("bigint").alias("token_id"))
    )


def encode(
    df: DataFrame, key: str, tokens: str, vocab: DataFrame, unknown: int | None = None,
    head: int = HEAD,
) -> DataFrame:
    """``key`` and ``ids``: the ids of the words in ``tokens``, in their order.

    Tokens with a low id, the frequent ones, are looked up where the rows lie,
    in a broadcast table of bounded size; each distinct word of a batch once.
    Only what that table lacks becomes rows and is shuffled by word, and as
    those words are rare none is a hot spot. Words outside the vocabulary
    become ``unknown`` or are left out. ``key`` must be unique.
    """
    frequent = (F.col("token_id") < head) & (F.octet_length("token") <= HEAD_BYTES)
    near = vocab.where(frequent).select("token", "token_id").toArrow()
    shared = df.sparkSession.sparkContext.broadcast(
        (near.column("token").combine_chunks(), near.column("token_id").combine_chunks())
    )

    def make():
        known, numbers = shared.value

        def each(batch: pa.RecordBatch):
            lists = batch.column(1)
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            n_bytes = pc.fill_null(pc.binary_length(lists.flatten()), 0).to_numpy(zero_copy_only=False)
            ends = np.r_[0, np.cumsum(n)]
            sizes = np.diff(np.r_[0, np.cumsum(n_bytes, dtype=np.int64)][ends]) + WORD_BYTES * n
            # Larger slices than usual, as each looks into the whole table anew.
            for start, rows in slices(sizes, LOOK_UP):
                yield numbered(batch.slice(start, rows), n[start : start + rows])

        def numbered(batch: pa.RecordBatch, n: np.ndarray):
            words = batch.column(1).flatten().dictionary_encode()
            of_kind = numbers.take(pc.index_in(words.dictionary, value_set=known))
            ids = of_kind.take(words.indices)
            missed = np.flatnonzero(pc.and_(pc.is_null(ids), pc.is_valid(words.indices)).to_numpy(zero_copy_only=False))
            ends = np.r_[0, np.cumsum(n)].astype(np.int32)
            at = missed - ends[np.searchsorted(ends, missed, side="right") - 1]
            spots = pa.StructArray.from_arrays(
                [pa.array(at, pa.int32()), words.dictionary.take(words.indices.take(pa.array(missed)))], ["_at", "token"]
            )
            cuts = np.searchsorted(missed, ends).astype(np.int32)
            return [
                batch.column(0), pa.ListArray.from_arrays(pa.array(ends), ids),
                pa.ListArray.from_arrays(pa.array(cuts), spots),
            ]

        return each

    schema = T.StructType(
        [df.schema[key], *T._parse_datatype_string("_near array<bigint>, _missed array<struct<_at:int,token:string>>").fields]
    )
    found = stored(map_batches(df.select(key, tokens), make, schema), "looked-up")
    real = F.filter("_near", lambda x: x.isNotNull())
    if not found.agg(F.max(F.size("_missed"))).first()[0]:
        return found.select(key, real.alias("ids"))
    far = vocab.where(~frequent).select("token", "token_id")
    rest = found.select(key, F.explode("_missed").alias("m")).select(key, "m.*")
    rest = rest.join(far, "token", "inner" if unknown is None else "left")
    number = F.col("token_id") if unknown is None else F.coalesce("token_id", F.lit(unknown).cast("bigint"))
    late = rest.groupBy(key).agg(F.collect_list(F.struct("_at", number.alias("token_id"))).alias("_far"))
    placed = F.transform("_near", lambda x, i: F.when(x.isNotNull(), F.struct(i.alias("_at"), x.alias("token_id"))))
    both = F.sort_array(F.concat(F.filter(placed, lambda x: x.isNotNull()), F.coalesce("_far", F.array())))
    return found.join(late, key, "left").select(
        key, F.when(F.col("_far").isNull(), real).otherwise(F.transform(both, lambda x: x["token_id"])).alias("ids")
    )


ENCODE_BATCH = 256
Encoder = Callable[[list[str]], list[list[int]]]


def _encode(encoder: Encoder, texts: list[str]) -> tuple[list, list]:
    """Ids and errors; a failing batch is run again row by row."""
    try:
        ids = [[int(x) for x in row] for row in encoder(texts)]
        if len(ids) != len(texts):
            raise ValueError(f"{len(ids)} rows for {len(texts)} texts")
        return ids, [None] * len(ids)
    except Exception as failure:
        if len(texts) == 1:
            return [None], [f"{type(failure).__name__}: {failure}"]
    rows = [_encode(encoder, [t]) for t in texts]
    return [i[0] for i, _ in rows], [e[0] for _, e in rows]


def encode_with(
    df: DataFrame, text: str, make_encoder: Callable[[], Encoder], batch_size: int = ENCODE_BATCH
) -> DataFrame:
    """Add ``ids`` and ``encode_error`` by a user's own tokenizer.

    The tokenizer is made once per task and takes a list of at most
    ``batch_size`` texts, which are of some 1 MB in all or one text, so what a
    worker holds is bounded; a row that fails keeps its error. A null text has null ids and no error.
    """

    def encoded(encoder: Encoder, texts: list[str | None]) -> list[tuple]:
        live = [t for t in texts if t is not None]
        ids, errors = [], []
        for at in range(0, len(live), batch_size):
            some = _encode(encoder, live[at : at + batch_size])
            ids += some[0]
            errors += some[1]
        found = iter(zip(ids, errors))
        return [(None, None) if t is None else next(found) for t in texts]

    @F.pandas_udf("ids array<bigint>, encode_error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for batch in batches:
            sizes = np.array([len(t or "") for t in batch], np.int64)
            for at, n in slices(sizes):
                texts = batch.iloc[at : at + n].tolist()
                yield pd.DataFrame(encoded(encoder, texts), columns=["ids", "encode_error"])

    return df.withColumn("_encoded", run(F.col(text))).select(*df.columns, "_encoded.ids", "_encoded.encode_error")


def truncate(ids: Column, limit: int = MAX_TOKENS) -> Column:
    """Keep the head of a token list."""
    return F.slice(ids, 1, limit)


def separator_lost(ids: Column, sep_id: int | Column = SEP_ID, limit: int = MAX_TOKENS) -> Column:
    """Whether truncation cuts off the last separator."""
    sep = F.lit(sep_id) if isinstance(sep_id, int) else sep_id
    return F.array_contains(ids, sep) & (last_place(ids, sep) > limit)


def last_place(ids: Column, token: Column) -> Column:
    """1-based place of the last occurrence; size + 1 if there is none."""
    return F.size(ids) - F.array_position(F.reverse(ids), token).cast("int") + 1


def truncate_pair(
    prompt: Column, completion: Column, max_prompt: int = MAX_PROMPT,
    max_total: int = MAX_TOKENS, keep: str = "end",
) -> tuple[Column, Column]:
    """Prompt and completion within the preference limits.

    ``keep`` names the side of the prompt that stays; of both together the
    head stays.
    """
    if keep == "end":
        start = F.greatest(F.size(prompt) - max_prompt, F.lit(0)) + 1
    elif keep == "start":
        start = F.lit(1)
    else:
        raise ValueError(f"keep {keep!r} is neither end nor start")
    cut = F.slice(prompt, start, F.lit(min(max_prompt, max_total)))
    return cut, F.slice(completion, F.lit(1), F.lit(max_total) - F.size(cut))
