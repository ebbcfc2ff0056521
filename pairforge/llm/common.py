"""Helpers that the operators of this package share.

Documents are told apart by ``doc_id`` together with their text, as ids may be
null or repeat. Intermediate tables lie in the shared folder, so a lost
executor never loses them, and are deleted once their readers are done.
"""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairforge.session import fresh_path, owners

#: Odd 64-bit multipliers of a public integer mixer (fixed values).
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers; equal in, equal out."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def seeds(n: int, start: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(start))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


class Workspace:
    """Intermediate tables of one call, deleted together at its end.

    ``keep`` writes a table that outlives the workspace: the result. Inside
    another workspace the result belongs to that one. Tables that ``stored``
    of the session writes meanwhile belong to it as well.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> "Workspace":
        owners.append(self.paths)
        return self

    def __exit__(self, *_) -> None:
        del owners[next(i for i, paths in enumerate(owners) if paths is self.paths)]
        for path in self.paths:
            self.delete(path)

    def delete(self, path: str) -> None:
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(there, True)

    def path(self, name: str) -> str:
        self.paths.append(fresh_path(self.spark, name))
        return self.paths[-1]

    def stored(self, df: DataFrame, name: str, *partitions: str, at: str | None = None) -> DataFrame:
        """Write a step's table and read it back; ``at`` a path of the caller, who deletes it.

        Spark deletes shuffle files when the driver has collected the step that
        made them, by default every half hour; here after each step, so that
        the shuffles of many steps do not add up on the executors' disks.
        """
        out = _written(df, at or self.path(name), *partitions)
        self.spark._jvm.System.gc()
        return out

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        above = [paths for paths in owners if paths is not self.paths]
        if above:
            above[-1].append(path)
        return _written(df, path)

    def small(self, df: DataFrame, name: str, max_rows: int = 100_000, weight: Column | None = None) -> DataFrame:
        """Store a side of a join; broadcast it only if it is counted small.

        Any other goes through a shuffle join with the same result. ``weight``
        counts more for a row that holds an array.
        """
        kept = self.stored(df, name)
        n = kept.agg(F.count(F.lit(1)) if weight is None else F.sum(weight + 1)).first()[0]
        return F.broadcast(kept) if (n or 0) <= max_rows else kept


#: Rows of whole texts, or of sets of their shingles, that Spark hands to Python at once.
TEXT_ROWS = 1_000
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside gets Arrow batches of at most ``TEXT_ROWS`` rows.

    A batch lies in the executor twice, on Spark's and on Python's side, for
    each running task; the session's own limit is made for short rows.
    """
    was = spark.conf.get(BATCH_ROWS)
    if 0 < int(was) <= TEXT_ROWS:
        yield
        return
    spark.conf.set(BATCH_ROWS, str(TEXT_ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, was)


def _written(df: DataFrame, path: str, *partitions: str) -> DataFrame:
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partitions).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(text: str = "text") -> Column:
    """A text's part of a document's key; null and empty texts differ."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("\0null")))


def id_key(name: str = "doc_id") -> Column:
    """A document id that joins also if it is null."""
    return F.coalesce(F.col(name).cast("bigint"), F.lit(-(1 << 63)))


def held_out(name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def arrow_schema(schema: str | T.StructType) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)


def ascii_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words between ASCII white space, A to Z in lower case.

    The distinct words, the number of each word of all texts, and its text.
    """
    raw = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.zeros(0, np.uint8)
    if raw.buffers()[2] is not None:
        data = np.frombuffer(raw.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data | 32, data)
    inside = (data != 32) & ((data < 9) | (data > 13))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    borders = (offsets - offsets[0])[:-1]
    borders = borders[borders < len(data)]
    first[borders] = inside[borders]
    at = np.flatnonzero(first)
    of_text = np.searchsorted(offsets - offsets[0], at, side="right") - 1
    starts = (np.cumsum(inside) - 1)[at]
    ends = np.r_[starts, inside.sum()].astype(np.int64)
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[inside]))]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), buffers).dictionary_encode()
    return words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False), of_text


def text_slices(texts: pa.Array, most_bytes: int = 1 << 20, most_rows: int = 2_000) -> Iterator[tuple[int, int]]:
    """Start and length of runs of texts: at most so many rows and bytes, or one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at, n = 0, len(ends)
    while at < n:
        before = ends[at] - sizes[at]
        end = int(np.searchsorted(ends, before + most_bytes, side="right"))
        end = min(max(end, at + 1), at + most_rows, n)
        yield at, end - at
        at = end


def with_fields(schema: T.StructType, extra: str) -> T.StructType:
    """A schema and the fields of a DDL string after it."""
    return T.StructType([*schema.fields, *T._parse_datatype_string(extra).fields])


def give_back() -> None:
    """Return memory that is free again to the system, as a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers of this session the package, once."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[1]
        made = shutil.make_archive(
            os.path.join(tempfile.mkdtemp(prefix="pairforge-code-"), "pairforge_code"), "zip", root.parent, root.name
        )
        spark.sparkContext.addPyFile(made)
        _shipped.add(app)


def arrow_map(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[dict]]], schema: str | T.StructType
) -> DataFrame:
    """``mapInArrow`` whose function is made once in each task.

    ``make()`` returns a function from a batch to dicts of equally long columns.
    """
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                for columns in each(batch):
                    yield record(columns, kinds)
        each = batch = columns = None
        give_back()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def record(columns: dict, kinds: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for f in kinds:
        x = columns[f.name]
        if isinstance(x, pa.ChunkedArray):
            x = x.combine_chunks()
        arrays.append(x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, type=f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=kinds)


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def grouped_map(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    each: Callable[[pa.Table, np.ndarray], Iterable[dict]],
    schema: str,
    rows: int = 16_384,
) -> DataFrame:
    """Rows of equal keys together, many groups at a time.

    The rows are dealt out by ``keys`` and sorted by ``keys`` and ``order``;
    ``each`` gets whole groups as one table, about ``rows`` rows or one group
    more, and the number of the group of every row. Groups must be bounded by
    the caller. No group is split.
    """
    kinds = arrow_schema(schema)

    def groups(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, dtype=bool)
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.cumsum(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n >= rows:
                t = pa.Table.from_batches(waiting)
                g = groups(t)
                whole = int(np.searchsorted(g, g[-1]))
                if whole:
                    for columns in each(t.slice(0, whole), g[:whole]):
                        yield record(columns, kinds)
                waiting = t.slice(whole).to_batches()
                n = t.num_rows - whole
        if n:
            t = pa.Table.from_batches(waiting)
            for columns in each(t, groups(t)):
                yield record(columns, kinds)
        waiting = t = batch = columns = None
        give_back()

    ship(df.sparkSession)
    dealt = df.repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, schema)


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every end of the undirected edges ``(a, b)``.

    Large star and small star in turn, each a minimum per node and a join, so
    neither a hub's links nor a whole component ever lie in one task. The
    edges are written after each round; rounds grow with the logarithm of the
    longest path. Root is the smallest node.
    """

    def star(e: DataFrame, larger: bool) -> DataFrame:
        if larger:
            both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(low, "a")
        if larger:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            out = out.union(low.select("a", F.col("m").alias("b")))
        return out.where("a != b").distinct()

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e = ws.stored(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    before = state(e)
    while before[0]:
        e = ws.stored(star(star(e, True), False), "edges")
        after = state(e)
        if tuple(after) == tuple(before):
            break
        before = after
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
