"""Whitening of embeddings by a covariance from variances alone.

Entries become integers, ``x = floor(256 * c) + 0``. Over the fit list, each
distinct vector once, two passes aggregate integers: the sums ``S`` and the
count ``n``; then the squares of the centred values of every dimension and of
the sum of every pair of dimensions. By polarisation half of
``Var(i + j) - Var(i) - Var(j)`` is the covariance of ``i`` and ``j``; all are
assembled into one matrix for ``eigh``.

The values are centred by the integer part of the mean, which leaves less than
one unit; the rest is taken off the sums of squares exactly, as
``n * sum(u^2) - sum(u)^2``. Integers that could outgrow 64 bits are calculated
as Python's, so no size or offset of the data loses a digit before the one
division at the end. Tasks send one row per dimension or pair, in limbs of
``LIMB`` bits that Spark adds up; the driver gets one row per pair of
dimensions, whatever the number of vectors.

Cases: null vectors and those with a null or non-finite entry are dropped; the
dimension is the length that most of the others have (the larger one of two
equally frequent), and vectors of other lengths, or without entries, are
dropped too; an entry beyond the range of a long takes the end of the range;
components without variance are left out, so equal vectors alone give no rows;
rows that repeat, also with one id or a null id, each get their result; other
columns are ignored; an empty table gives no rows. A deviation of more than 38
digits is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairforge.llm.common import Workspace, arrow_map, arrow_schema, partitions, record, ship

SCALE = 256.0
COMPONENTS = 4
#: Rows that are squared together; keeps sums of squares of 25 bits in 63.
ROWS = 4_096
LIMB = 40
LIMBS = 6
#: Centred values up to here are squared in 64 bits.
NARROW = 1 << 24
#: A variance below this share of the largest is rounding.
NO_VARIANCE = 1e-12


def integers(vectors: pa.Array, length: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their entries as ``floor(256 c) + 0`` in 64 bits."""
    lists = vectors.cast(pa.large_list(pa.float64()))
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten()
    flat = values.to_numpy(zero_copy_only=False)  # null entries become nan
    bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
    ends = np.cumsum(sizes)
    fine = (sizes > 0) & (bad[ends] == bad[ends - sizes])
    if length is not None:
        fine &= sizes == length
    rows = np.flatnonzero(fine)
    if length is None or not len(rows):
        return rows, sizes[rows]
    x = np.floor(flat[np.repeat(fine, sizes)].reshape(len(rows), length) * SCALE) + 0.0
    inside = np.clip(x, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    return rows, np.where(x >= 2.0**63, np.iinfo(np.int64).max, inside)


def packed(x: np.ndarray) -> pa.Array:
    """Each row as bytes, in the narrowest width that holds it; equal rows are equal."""
    out = np.empty(len(x), dtype=object)
    top = np.maximum(x.max(axis=1, initial=0), -(x.min(axis=1, initial=0) + 1))
    taken = np.zeros(len(x), dtype=bool)
    for kind in ("<i2", "<i4", "<i8"):
        some = np.flatnonzero(~taken & (top <= np.iinfo(kind).max))
        raw = np.ascontiguousarray(x[some].astype(kind)).view(np.uint8)
        for i, row in zip(some, raw):
            out[i] = row.tobytes()
        taken[some] = True
    return pa.array(out, type=pa.binary())


def unpacked(raw: pa.Array, length: int) -> np.ndarray:
    sizes = np.array([len(v.as_buffer()) for v in raw], dtype=np.int64) // length
    out = np.empty((len(raw), length), dtype=np.int64)
    for width in np.unique(sizes):
        some = np.flatnonzero(sizes == width)
        data = b"".join(raw[int(i)].as_py() for i in some)
        out[some] = np.frombuffer(data, dtype=f"<i{width}").reshape(len(some), length)
    return out


def _limbs(value: int) -> list[int]:
    """``value`` as limbs that may be added up one by one; the last has the sign."""
    out = [(value >> (LIMB * k)) & ((1 << LIMB) - 1) for k in range(LIMBS - 1)]
    return [*out, value >> (LIMB * (LIMBS - 1))]


def _exact_totals(
    df: DataFrame, n_keys: int, add: Callable[[np.ndarray, np.ndarray], np.ndarray], length: int
) -> list[int]:
    """Exact sums over all packed rows of ``df``.

    ``add(sums, x)`` returns the sums, an array of ``n_keys`` Python integers,
    with those of the rows ``x``. One row per key leaves a task.
    """
    names = [f"l{k}" for k in range(LIMBS)]
    schema = "key int, " + ", ".join(f"{c} bigint" for c in names)
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = np.zeros(n_keys, dtype=object), False
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                sums, seen = add(sums, unpacked(batch.column(0).slice(at, ROWS), length)), True
        if seen:
            limbs = np.array([_limbs(int(v)) for v in sums], dtype=np.int64).reshape(n_keys, LIMBS)
            yield record({"key": np.arange(n_keys)} | dict(zip(names, limbs.T)), kinds)

    ship(df.sparkSession)
    rows = df.mapInArrow(run, schema).groupBy("key").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    out = [0] * n_keys
    keys = rows.column("key").to_pylist()
    for key, *limbs in zip(keys, *(rows.column(c).to_pylist() for c in names)):
        out[key] = sum(v << (LIMB * k) for k, v in enumerate(limbs))
    return out


def _add_sums(sums: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Count of the rows, then the sum of each dimension."""
    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    own = high.astype(object) * (1 << 32) + low.astype(object)
    return sums + np.r_[np.array([len(x)], dtype=object), own]


def centred(x: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """``x - middle``; Python integers where 64 bits could not hold squares of sums."""
    wide = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) >= 1 << 61
    if wide or max(map(abs, middle.tolist()), default=0) >= 1 << 61:
        return x.astype(object) - middle.astype(object)
    u = x - middle.astype(np.int64)
    return u if np.abs(u).max(initial=0) < NARROW else u.astype(object)


class Fit:
    """The fitted numbers: count, means, components, their variances."""

    def __init__(self, length: int, totals: list[int], squares: list[int], components: int):
        self.n, self.length = totals[0], length
        #: Integer part of the mean, and what is left of the sum.
        self.middle = np.array([s // self.n for s in totals[1:]], dtype=object)
        self.rest = np.array([s % self.n for s in totals[1:]], dtype=object)
        n, rest, k = self.n, self.rest.tolist(), length
        # n^2 times the variance of each dimension, then of each pair's sum.
        own = [n * squares[i] - rest[i] * rest[i] for i in range(length)]
        cov = np.zeros((length, length))
        for i in range(length):
            cov[i, i] = own[i] / (n * n)
            for j in range(i + 1, length):
                both = n * squares[k] - (rest[i] + rest[j]) ** 2
                cov[i, j] = cov[j, i] = (both - own[i] - own[j]) / (2 * n * n)
                k += 1
        values, vectors = np.linalg.eigh(cov)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        real = values > NO_VARIANCE * max(values[0], 0.0)
        self.values, self.vectors = values[real], vectors[:, real]
        self.explained = self.values / np.trace(cov) if real.any() else self.values
        self.covariance = cov

    def whitened(self, u: np.ndarray) -> np.ndarray:
        """Rows centred by ``middle`` on the components, by standard deviations."""
        mean = np.array([r / self.n for r in self.rest.tolist()])
        return ((u.astype(np.float64) - mean) @ self.vectors) / np.sqrt(self.values)

    def deviations(self, u: np.ndarray) -> list[int]:
        """Exact ``sum((n x - S)^2)`` of each row."""
        top = max(int(np.abs(u).max(initial=0)), 1) * self.n + self.n
        if u.dtype != object and top < 1 << 47 and self.length <= 1 << 13:
            y = u * self.n - self.rest.astype(np.int64)
            high, low = y >> 24, y & 0xFFFFFF
            squares = ((high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1))
            return [(a << 48) + (b << 25) + c for a, b, c in zip(*(s.tolist() for s in squares))]
        y = u.astype(object) * self.n - self.rest
        return (y * y).sum(axis=1).tolist()


def fit(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> tuple[Fit | None, float]:
    """Fit on each distinct vector once; also the largest entry of the whitened
    fit list's covariance minus the identity. None if no vector takes part."""
    spark = vectors.sparkSession
    rows = vectors.select(column)

    def make_sizes():
        def each(batch: pa.RecordBatch):
            _, sizes = integers(batch.column(0))
            size, n = np.unique(sizes, return_counts=True)
            yield {"size": size, "n": n}

        return each

    sizes = arrow_map(rows, make_sizes, "size int, n bigint").groupBy("size").agg(F.sum("n").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return None, 0.0
    length = most["size"]

    def make_packed():
        def each(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, ROWS):
                _, x = integers(batch.column(0).slice(at, ROWS), length)
                if x.ndim == 2:
                    yield {"x": packed(x)}

        return each

    with Workspace(spark) as ws:
        # Copies are united in the tasks before they move.
        distinct = ws.stored(arrow_map(rows, make_packed, "x binary").distinct(), "fit-list")
        totals = _exact_totals(distinct, length + 1, _add_sums, length)
        middle = np.array([s // totals[0] for s in totals[1:]], dtype=object)

        def add_squares(sums: np.ndarray, x: np.ndarray) -> np.ndarray:
            u = centred(x, middle)
            parts = [(u * u).sum(axis=0)]
            for i in range(length - 1):
                both = u[:, i + 1 :] + u[:, i : i + 1]
                parts.append((both * both).sum(axis=0))
            return sums + np.concatenate(parts).astype(object)

        squares = _exact_totals(distinct, length * (length + 1) // 2, add_squares, length)
        model = Fit(length, totals, squares, components)
        return model, _identity_error(distinct, model)


def _identity_error(distinct: DataFrame, model: Fit) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(model.values)
    if not k:
        return 0.0
    shared = distinct.sparkSession.sparkContext.broadcast(model)
    kinds = arrow_schema("a int, b int, total double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Fit = shared.value
        total = np.zeros((k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                w = m.whitened(centred(unpacked(batch.column(0).slice(at, ROWS), m.length), m.middle))
                total += w.T @ w  # the mean of the fit list is taken off already
        a, b = np.divmod(np.arange(k * k), k)
        yield record({"a": a, "b": b, "total": total.ravel()}, kinds)

    ship(distinct.sparkSession)
    sums = distinct.mapInArrow(run, "a int, b int, total double").groupBy("a", "b").agg(F.sum("total").alias("total"))
    return max(abs(r["total"] / model.n - (r["a"] == r["b"])) for r in sums.collect())


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """One row per vector and component.

    ``vec_id, component`` (from 1, by falling variance), ``n, deviation`` (as a
    decimal of 38 digits), ``whitened, explained, identity_error``. Nothing is
    shuffled but the distinct vectors of the fit.
    """
    spark = vectors.sparkSession
    schema = (
        "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, "
        "explained double, identity_error double"
    )
    model, error = fit(vectors, components, column)
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)

    def make():
        import decimal

        m: Fit = shared.value
        k = len(m.values)
        limit = 10**38

        def each(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                rows, x = integers(some.column(1), m.length)
                if x.ndim != 2:
                    continue
                u = centred(x, m.middle)
                far = [decimal.Decimal(v) if v < limit else None for v in m.deviations(u)]
                every = np.repeat(np.arange(len(rows)), k)
                yield {
                    "vec_id": some.column(0).take(pa.array(rows[every])),
                    "component": np.tile(np.arange(1, k + 1), len(rows)),
                    "n": np.full(len(every), m.n),
                    "deviation": pa.array(far, type=pa.decimal128(38, 0)).take(pa.array(every)),
                    "whitened": m.whitened(u).ravel(),
                    "explained": np.tile(m.explained, len(rows)),
                    "identity_error": np.full(len(every), error),
                }

        return each

    return arrow_map(vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), column), make, schema)
