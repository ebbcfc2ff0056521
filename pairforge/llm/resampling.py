"""Resampling of documents towards a target text distribution.

Features are runs of one to three words, hashed into buckets by their CRC-32.
A text is scanned once: its words, joined by one space, give a running CRC that
is stored before and after every word. The CRC of any run follows from two of
these prefixes: shifting the earlier one by the run's length in GF(2), with one
table of four bytes for each power of two, and taking it off the later one
leaves the run's own CRC. So no run is ever built as a string.

The buckets of all runs of a document, 14 bits each, are written with its id;
counting them and weighing the documents read that table, not the texts.
Counts are bounded by the number of buckets in each task and come to the
driver as one number per bucket. The draw orders small rows by range.

Cases: a null text has no words; a text without words has no features, weight
0 and is never drawn; very long texts and words are handled in slices of the
texts and need memory for one text; rows of one id are separate documents with
equal noise; a null id is hashed as an empty text and comes last among ties;
other columns are ignored; an empty table gives no rows, an empty target counts
nothing.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairforge.llm.common import Workspace, arrow_map, column, partitions, text_slices
from pairforge.operators.position import ranked

ORDERS = 3
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 5
SEED = 42

#: The reflected polynomial of CRC-32 (fixed value).
POLYNOMIAL = 0xEDB88320
#: Lower case for A to Z, a space for what parts words, all other bytes as they are.
FOLD = bytes(
    b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


@lru_cache(maxsize=1)
def shifts() -> np.ndarray:
    """For each power of two: what each value of each of a CRC's four bytes
    becomes when so many zero bytes follow. ``[power, byte, value]``."""
    step = np.zeros((4, 256), dtype=np.uint32)  # one zero byte
    for value in range(256):
        crc = value
        for _ in range(8):
            crc = (crc >> 1) ^ (POLYNOMIAL if crc & 1 else 0)
        step[0, value] = crc
    for byte in range(1, 4):
        step[byte] = np.arange(256, dtype=np.uint32) << (8 * (byte - 1))
    out = [step]
    while len(out) < 40:
        out.append(_apply(out[-1], _apply(out[-1], _values())))
    return np.stack(out)


def _values() -> np.ndarray:
    return np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * byte) for byte in range(4)])


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return (
        table[0][crc & 0xFF] ^ table[1][(crc >> 8) & 0xFF] ^ table[2][(crc >> 16) & 0xFF] ^ table[3][crc >> 24]
    )


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Each CRC after as many zero bytes, one table look-up per set bit."""
    out = crc.astype(np.uint32)
    power, left = 0, n_bytes.astype(np.int64)
    while left.any():
        some = np.flatnonzero(left & 1)
        out[some] = _apply(shifts()[power], out[some])
        power, left = power + 1, left >> 1
    return out


class Runs:
    """Buckets of all runs of a slice of texts, in one running CRC over them.

    All texts are scanned as one; runs across two texts are left out.
    """

    def __init__(self, texts: pa.Array, buckets: int = BUCKETS, orders: int = ORDERS):
        words = [(t.as_py() or "").encode("utf-8", "surrogatepass").translate(FOLD).split() for t in texts]
        self.n_words = np.fromiter(map(len, words), np.int64, len(words))
        every = list(chain.from_iterable(words))
        n = len(every)
        length = np.fromiter(map(len, every), np.int64, n)
        crc = zlib.crc32
        # After each word; the space before a word is part of the scan.
        after = np.fromiter(accumulate(every, lambda c, w: crc(b" " + w, c), initial=0), np.uint32, n + 1)
        before = self._space(after[:-1])
        after = after[1:]
        end = np.cumsum(length + 1)
        begin = end - length
        first = np.cumsum(self.n_words) - self.n_words
        of_text = np.repeat(np.arange(len(words)), self.n_words)
        in_text = np.arange(n) - first[of_text]
        #: Runs per text, and the first run of each order in it.
        counts = np.stack([np.maximum(self.n_words - k, 0) for k in range(orders)])
        self.n_runs = counts.sum(axis=0)
        place = np.cumsum(self.n_runs) - self.n_runs + np.cumsum(counts, axis=0) - counts
        self.buckets = np.zeros(int(self.n_runs.sum()), dtype=np.uint16)
        for k in range(orders):
            starts = np.flatnonzero(in_text + k < self.n_words[of_text])
            a, b = before[starts], after[starts + k]
            own = b ^ shifted(a, end[starts + k] - begin[starts])
            self.buckets[place[k][of_text[starts]] + in_text[starts]] = own % np.uint32(buckets)

    @staticmethod
    def _space(crc: np.ndarray) -> np.ndarray:
        """Each running CRC after one more space."""
        inner = crc ^ np.uint32(0xFFFFFFFF)
        return shifts()[0][0][(inner ^ np.uint32(32)) & np.uint32(0xFF)] ^ (inner >> np.uint32(8)) ^ np.uint32(0xFFFFFFFF)


def scan(texts: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``keys``, ``n_words``, and ``runs``: the buckets of all runs, 16 bits each."""
    if buckets > 1 << 16:
        raise ValueError("buckets need more than 16 bits")

    def make():
        def each(batch: pa.RecordBatch):
            text = batch.column(batch.num_columns - 1)
            for at, n in text_slices(text):
                found = Runs(text.slice(at, n), buckets)
                ends = 2 * np.r_[0, np.cumsum(found.n_runs)]
                raw = found.buckets.astype("<u2").tobytes()
                yield {k: batch.column(i).slice(at, n) for i, k in enumerate(keys)} | {
                    "n_words": found.n_words, "runs": [raw[a:b] for a, b in zip(ends, ends[1:])]
                }

        return each

    schema = "".join(f"`{k}` {texts.schema[k].dataType.simpleString()}, " for k in keys)
    return arrow_map(texts.select(*keys, "text"), make, schema + "n_words bigint, runs binary")


def bucket_counts(runs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs; at most ``buckets`` rows leave a batch."""

    def make():
        def each(batch: pa.RecordBatch):
            raw = b"".join([x.as_buffer() for x in batch.column(0)])
            found = np.bincount(np.frombuffer(raw, dtype="<u2"), minlength=buckets)
            some = np.flatnonzero(found)
            yield {"bucket": some, "n": found[some]}

        return each

    rows = arrow_map(runs.select("runs"), make, "bucket int, n bigint")
    rows = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log-ratio of smoothed frequencies, rounded down."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n))))
            for s, t in zip(source.tolist(), target.tolist())
        ],
        dtype=np.int64,
    )


def weighed(runs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the sum of the gains of all runs."""
    shared = runs.sparkSession.sparkContext.broadcast(gain)

    def make():
        own = shared.value

        def each(batch: pa.RecordBatch):
            raw = batch.column(2)
            n = np.array([len(x.as_buffer()) // 2 for x in raw], dtype=np.int64)
            weight = [int(own[np.frombuffer(x.as_buffer(), dtype="<u2")].sum()) for x in raw]
            yield {
                "doc_id": batch.column(0), "n_words": column(batch, "n_words"), "n_features": n,
                "weight": np.array(weight, dtype=np.int64),
            }

        return each

    schema = "doc_id bigint, n_words bigint, n_features bigint, weight bigint"
    return arrow_map(runs.select("doc_id", "n_words", "runs"), make, schema)


def noise(name: str = "doc_id", seed: int = SEED):
    """Gumbel noise in thousandths, rounded down, from a hash of the id."""
    mixed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(name).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(mixed, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; rank is null if it is not drawn."""
    with Workspace(docs.sparkSession) as ws:
        own = scan(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ["doc_id"])
        own = ws.stored(own, "runs-of-documents")
        wanted = ws.stored(scan(target.select("text"), []), "runs-of-target")
        gain = gains(bucket_counts(own), bucket_counts(wanted))
        scored = weighed(own, gain).withColumns(
            {"score": F.col("weight") + noise("doc_id", seed), "long": F.col("n_words") >= min_words}
        )
        n_long = own.where(F.col("n_words") >= min_words).count()
        # Those that can be drawn come first; rows that tie in all are alike.
        order = [
            F.desc("long"), F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features"), F.col("weight"), F.col("row"),
        ]
        numbered = scored.withColumn("row", F.monotonically_increasing_id())
        placed = ranked(numbered, order, partitions=partitions(docs.sparkSession))
        drawn = F.col("long") & (F.col("rank") <= percent * n_long // 100)
        return ws.keep(
            placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("rank")).alias("rank")), "drawn"
        )


def drawn_documents(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """The documents of the drawn ids, whole and with all their columns."""
    ids = scores.where(F.col("rank").isNotNull()).select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_semi")
