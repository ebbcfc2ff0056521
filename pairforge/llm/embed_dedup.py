"""Near-duplicate embeddings by sorted projection passes.

Vectors of a label that are equal are one class. In each of ``PASSES`` passes a
class gets ``BITS`` signs of random projections of what its unit vector differs
by from the label's mean, joined to one code; the classes are sorted by label
and code, and each is compared with the next ``WINDOW`` classes, also across the
border to the next partition. Verified pairs of all passes are united to
components. Taking off the mean lets the signs part vectors that all lie in one
direction, as those of a crowded label do.

The passes come in rounds. After the first, another round with new projections
runs over all labels that have more classes than a window; as long as a round
joins components, the labels it did so in get one more. So the number of passes
follows what the data still give, and not a setting.

Windows find enough links to connect a component, not each link of a large
one. So inside every component all classes are then compared, in blocks, which
gives the exact number of links; only counts leave a block. In a component of n
classes each is moved once for every block, n * n / ``BLOCK`` rows in all.

At cosine 0.98 two vectors of a label without a common direction share a sign
with probability 0.936. A pass finds the pair if the codes agree in about the
first log2(classes of the label / WINDOW) signs: one round misses one pair in
10^6 at 5,000 classes of a label. Where all cosines of a label are around 0.94,
the probability is 0.73, a pass finds one pair in 15 at 20,000 classes, and the
rounds that follow find the others.

Cases: a null label, and a vector that is null, empty, zero, or holds a null,
infinite or undefined component, links with nothing; vectors of different
length do not link; rows that repeat are vectors of their own and link with
each other; a component takes its smallest id that is not null; a row without
any id in its component is kept; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from pairforge.llm.common import (
    Workspace, arrow_map, arrow_schema, components, grouped_map, partitions, record, ship,
)

PASSES = 16
BITS = 60
WINDOW = 32
COSINE = 0.98
BLOCK = 8192
#: Rows of a block that are multiplied with the other block at once.
TILE = 1024
SEED = 11


def usable(name: str = "embedding") -> Column:
    """Whether a vector takes part at all."""
    fine = F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(name) > 0) & fine & F.exists(name, lambda x: x != 0), F.lit(False))


def matrix(lists: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, in double precision."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def by_length(t: pa.Table, name: str = "embedding"):
    """The rows of each vector length, as row numbers."""
    import pyarrow.compute as pc

    size = pc.list_value_length(t.column(name)).to_numpy(zero_copy_only=False)
    for n in np.unique(size):
        yield np.flatnonzero(size == n)


def _means(classes: DataFrame, ws: Workspace) -> DataFrame:
    """``label, size, mean``: the mean of the unit vectors of each label and length."""

    def make():
        def each(batch: pa.RecordBatch):
            t = pa.Table.from_batches([batch])
            label = t.column("label").to_numpy()
            for rows in by_length(t):
                x = unit(matrix(t.column("embedding").take(pa.array(rows))))
                own, of = np.unique(label[rows], return_inverse=True)
                sums = np.zeros((len(own), x.shape[1]))
                np.add.at(sums, of, x)
                k, d = x.shape[1], len(own)
                yield {
                    "label": np.repeat(own, k), "size": np.full(k * d, k), "at": np.tile(np.arange(k), d),
                    "total": sums.ravel(), "n": np.repeat(np.bincount(of), k),
                }

        return each

    sums = arrow_map(classes.select("label", "embedding"), make, "label int, size int, at int, total double, n bigint")
    sums = sums.groupBy("label", "size", "at").agg((F.sum("total") / F.sum("n")).alias("mean"))
    # One entry per dimension in each group.
    rows = sums.groupBy("label", "size").agg(F.array_sort(F.collect_list(F.struct("at", "mean"))).alias("m"))
    return ws.small(rows.select("label", "size", F.col("m.mean").alias("mean")), "label-means", 20_000)


def _codes(classes: DataFrame, means: DataFrame, passes: int, first: int) -> DataFrame:
    """Every class once per pass, with its code."""

    def make():
        def each(batch: pa.RecordBatch):
            t = pa.Table.from_batches([batch])
            for rows in by_length(t):
                part = t.take(pa.array(rows))
                x = unit(matrix(part.column("embedding"))) - matrix(part.column("mean"))
                places = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
                for k in range(first, first + passes):
                    planes = np.random.default_rng([SEED, k, x.shape[1]]).standard_normal((x.shape[1], BITS))
                    yield {
                        "pass": np.full(len(x), k), "label": part.column("label"),
                        "code": (x @ planes > 0) @ places, "node": part.column("node"),
                        "embedding": part.column("embedding"),
                    }

        return each

    schema = "pass int, label int, code bigint, node bigint, embedding array<float>"
    rows = classes.select("label", F.size("embedding").alias("size"), "node", "embedding").join(means, ["label", "size"])
    return arrow_map(rows.select("label", "node", "embedding", "mean"), make, schema)


def _pairs(t: pa.Table, window: int, cosine: float, cross: int | None = None) -> list[tuple]:
    """Close pairs in a sorted run; with ``cross`` only those over that row's border."""
    node, label, turn = (t.column(c).to_numpy() for c in ("node", "label", "pass"))
    found = []
    lists = t.column("embedding").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    x = np.zeros((len(node), int(size.max()) if len(size) else 0))
    for rows in by_length(t):
        x[rows, : size[rows[0]]] = unit(matrix(lists.take(pa.array(rows))))
    for step in range(1, min(window, len(node) - 1) + 1):
        i = np.arange(len(node) - step)
        j = i + step
        ok = (label[i] == label[j]) & (turn[i] == turn[j]) & (size[i] == size[j])
        if cross is not None:
            ok &= (i < cross) & (j >= cross)
        i, j = i[ok], j[ok]
        near = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
        found.append((node[i[near]], node[j[near]]))
    return found


def _window_pairs(
    classes: DataFrame, means: DataFrame, ws: Workspace, passes: int, first: int, window: int, cosine: float
) -> DataFrame:
    order = ["pass", "label", "code", "node"]
    codes = _codes(classes, means, passes, first)
    spread = codes.repartitionByRange(partitions(classes.sparkSession), *order).sortWithinPartitions(*order)
    carried = "pass int, label int, node bigint, embedding array<float>"
    schema = f"a bigint, b bigint, border int, place int, {carried}"

    kinds = arrow_schema(schema)

    def make_run():
        def run(batches):
            here = TaskContext.get().partitionId()
            tail, n_head = None, 0

            def border(rows: pa.Table, number: int, first_place: int) -> pa.RecordBatch:
                n = rows.num_rows
                none = [None] * n
                return record(
                    {"a": none, "b": none, "border": np.full(n, number), "place": first_place + np.arange(n)}
                    | {c: rows.column(c) for c in ("pass", "label", "node", "embedding")},
                    kinds,
                )

            for batch in batches:
                t = pa.Table.from_batches([batch]).drop_columns(["code"])
                if n_head < window:  # the first rows, for the partition before
                    yield border(t.slice(0, window - n_head), here, window + n_head)
                    n_head += min(t.num_rows, window - n_head)
                joined = t if tail is None else pa.concat_tables([tail, t])
                for a, b in _pairs(joined.combine_chunks(), window, cosine):
                    if len(a):
                        none = [None] * len(a)
                        yield record(
                            {"a": a, "b": b, "border": none, "place": none}
                            | {c: none for c in ("pass", "label", "node", "embedding")},
                            kinds,
                        )
                tail = joined.slice(max(0, joined.num_rows - window))
            if tail is not None:
                yield border(tail, here + 1, window - tail.num_rows)

        return run

    ship(classes.sparkSession)
    found = ws.stored(spread.mapInArrow(make_run(), schema), "windows")

    def over(t: pa.Table, group: np.ndarray):
        for start in np.flatnonzero(np.r_[True, group[1:] != group[:-1]]):
            rows = t.slice(start, int(np.searchsorted(group, group[start], side="right")) - start)
            cross = int((rows.column("place").to_numpy() < window).sum())
            for a, b in _pairs(rows.combine_chunks(), window, cosine, cross):
                yield {"a": a, "b": b}

    # Two windows of rows for each border between partitions.
    borders = found.where(F.col("border").isNotNull()).drop("a", "b")
    across = grouped_map(borders, ["border"], ["place"], over, "a bigint, b bigint")
    inside = found.where(F.col("a").isNotNull()).select("a", "b")
    return inside.unionByName(across)


def _link_counts(classes: DataFrame, roots: DataFrame, cosine: float) -> DataFrame:
    """``node, links``: vectors in other classes of the component that are close enough."""
    rows = classes.join(roots, "node")
    sizes = rows.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rows.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("node"), blocks))
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    rows = rows.select("root", "node", "n", "embedding", "own", other.alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    rows = rows.select("root", low.alias("x"), high.alias("y"), "own", "node", "n", "embedding")

    def each(t: pa.Table, group: np.ndarray):
        node, n, own, x = (t.column(c).to_numpy() for c in ("node", "n", "own", "x"))
        links = np.zeros(len(node), dtype=np.int64)
        for start in np.flatnonzero(np.r_[True, group[1:] != group[:-1]]):
            end = int(np.searchsorted(group, group[start], side="right"))
            v = unit(matrix(t.column("embedding").slice(start, end - start)))
            rows = np.arange(start, end)
            first = own[rows] == x[rows]
            alone = bool(first.all())  # one block with itself
            one, two = rows[first], rows if alone else rows[~first]
            w = v if alone else v[~first]
            for at in range(0, len(one), TILE):
                some = one[at : at + TILE]
                close = v[first][at : at + TILE] @ w.T >= cosine
                if alone:
                    close[np.arange(len(some)), at + np.arange(len(some))] = False
                else:
                    links[two] += close.T @ n[some]
                links[some] += close @ n[two]
        yield {"node": node, "links": links}

    found = grouped_map(rows, ["root", "x", "y"], ["node"], each, "node bigint, links bigint")
    return found.groupBy("node").agg(F.sum("links").alias("links"))


def _components(classes: DataFrame, ws: Workspace, passes: int, window: int, cosine: float) -> DataFrame:
    """``node, root`` of all linked classes, from rounds of passes."""
    means = _means(classes, ws)
    found = ws.stored(_window_pairs(classes, means, ws, passes, 0, window, cosine).distinct(), "window-links")
    roots = ws.stored(components(ws, found), "roots")
    # One pass compares all classes of a label that fits into a window.
    size = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    labels = ws.small(size.where(F.col("n") > window).select("label"), "long-labels")
    first = passes
    while labels.take(1):
        again = classes.join(labels, "label", "left_semi")
        more = _window_pairs(again, means, ws, passes, first, window, cosine).distinct()
        root_a = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        root_b = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        more = more.join(root_a, "a", "left").join(root_b, "b", "left")
        apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
        more = ws.stored(more.where(apart).select("a", "b"), "new-links")
        found = found.unionByName(more)
        if more.take(1):
            roots = ws.stored(components(ws, found), "roots")
        gained = classes.join(more.select(F.col("a").alias("node")).distinct(), "node").select("label").distinct()
        labels = ws.small(gained, "labels-that-gained")
        first += passes
    return roots


def near_duplicates(
    vectors: DataFrame, passes: int = PASSES, window: int = WINDOW, cosine: float = COSINE
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per vector."""
    with Workspace(vectors.sparkSession) as ws:
        return ws.keep(_near_duplicates(vectors, ws, passes, window, cosine), "near-vectors")


def _near_duplicates(vectors: DataFrame, ws: Workspace, passes: int, window: int, cosine: float) -> DataFrame:
    taking = F.col("label").isNotNull() & usable()
    node = F.when(taking, F.xxhash64("label", "embedding")).alias("node")
    rows = vectors.select("vec_id", F.col("label").cast("int").alias("label"),
                          F.col("embedding").cast("array<float>").alias("embedding"))
    rows = rows.select("vec_id", "label", node, "embedding")
    classes = rows.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.first("label").alias("label"), F.first("embedding").alias("embedding"),
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"),
    )
    classes = ws.stored(classes, "vector-classes")
    roots = _components(classes, ws, passes, window, cosine)
    links = _link_counts(classes.select("node", "n", "embedding"), roots, cosine)
    rooted = classes.select("node", "n", "least").join(roots, "node", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(least, "root").join(links, "node", "left")
    found = found.select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    found = ws.stored(found, "class-links")
    out = rows.select("vec_id", "node").join(found, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
