"""Near-duplicate documents by a chosen-path similarity join.

Documents with equal shingle sets are one class. In each of ``TREES``
independent trees a class is in the node of its minwise shingle; a node with
more than ``LEAF`` classes is branched by the minwise shingle under a hash that
the path so far seeds, down to ``DEPTH``. Two sets of similarity s part at a
branch with probability 1 - s, so a tree of depth d finds a pair with
probability s^d: at s = 0.8 and full depth 16 trees miss 2 in 10,000 pairs, and
at depth 2 one in 10^7.

Small nodes are compared exhaustively, by size and a sketch of ``BINS`` minima
first; the sketch's bound lies over five standard deviations under the
threshold. What is left is confirmed on the full sets of 64-bit shingle hashes.

Only components are asked for, so in a small node classes that are surely
close to its first one are compared with that one alone; should one of these
pairs fail on the full sets, its node is compared again without this rule. A
node still too large at full depth holds classes that share whatever is chosen.
All are compared with one hub. Whoever is not in the component of most of its
node after that meets the whole node, in blocks of bounded size that bring the
full sets along: a task tries the likeliest partner in each other component
first and goes on until one is confirmed or all have failed, so no cap decides
and no pair but a link leaves it. Pairs inside one component need no comparison.

Cases: a text without words has no shingles, links with nothing and is its own
component; one with fewer words than a shingle is one shingle; rows of one id
and different texts are separate documents; components take the smallest id
that is not null; a row without any id in its component has a null component
and is kept; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pairforge.llm.common import (
    Workspace, arrow_map, ascii_words, components, free_name, grouped_map, id_key, mix, seeds, text_key,
    text_batches, text_slices,
)

TREES = 16
DEPTH = 4
LEAF = 16
BINS = 128
#: A sketch below this share of equal minima is not compared further.
SKETCH = 0.6
#: In a small node, classes with this share of equal minima with its first one
#: are compared with it and not with each other.
CLOSE = 0.9
#: Shingles in one block of a large node.
BLOCK = 1 << 20
#: Pairs of one class whose sets are compared together.
TOGETHER = 512
#: Bytes of text whose words are looked at together, or one text.
BATCH = 1 << 20
SIMILARITY = 80  # in percent


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``k``-word shingles of each text."""
    distinct, code, of_text = ascii_words(texts)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
    word = hashes[code]
    sizes = np.bincount(of_text, minlength=len(texts))
    starts = np.cumsum(sizes) - sizes
    key = word.copy()
    for i in range(1, k):
        key[: len(word) - i] = mix(key[: len(word) - i]) + word[i:]
    key = mix(key)
    out = []
    for start, n in zip(starts, sizes):
        if n >= k:
            out.append(np.unique(key[start : start + n - k + 1]))
        elif n:
            one = np.uint64(n)  # the whole sequence as one shingle
            for w in word[start : start + n]:
                one = mix(np.array([one ^ w]))[0]
            out.append(np.array([one]))
        else:
            out.append(word[:0])
    return out


def paths(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """Node of each set in each tree at each depth; no set is empty."""
    out = np.empty((len(starts), trees, depth), dtype=np.uint64)
    for t, seed in enumerate(seeds(trees, 77)):
        node = np.full(len(starts), seed)
        for d in range(depth):
            low = np.minimum.reduceat(mix(flat ^ np.repeat(node, sizes)), starts)
            node = mix(node + np.uint64(d + 1)) ^ low
            out[:, t, d] = node
    return out


def sketch(values: np.ndarray) -> bytes:
    """A byte of the least hash in each bin of the sorted set; 0 for an empty bin."""
    borders = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - 7)
    at = np.searchsorted(values, borders)
    end = np.append(at[1:], len(values))
    low = values[np.minimum(at, len(values) - 1)]
    byte = (mix(low) % np.uint64(255)).astype(np.uint8) + np.uint8(1)
    return np.where(end > at, byte, 0).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, id, h, size, node, sketch, paths`` per row; ``node`` is the hash of the set."""

    def make():
        def each(batch: pa.RecordBatch):
            for at, n in text_slices(batch.column(3), BATCH):
                some = batch.slice(at, n)
                sets = shingle_sets(some.column(3), k)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(sizes)
                rows = [sets[i] for i in full]
                node: list = [None] * len(sets)
                marks: list = [None] * len(sets)
                ways: list = [None] * len(sets)
                if rows:
                    flat, own = np.concatenate(rows), sizes[full]
                    found = paths(flat, np.cumsum(own) - own, own, TREES, DEPTH)
                    for i, s, p in zip(full, rows, found):
                        node[i] = xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)
                        marks[i], ways[i] = sketch(s), p.view(np.int64).ravel()
                yield {
                    "doc_id": some.column(0), "id": some.column(1), "h": some.column(2),
                    "size": sizes, "node": node, "sketch": marks, "paths": ways,
                }

        return each

    schema = (
        "doc_id bigint, id bigint, h bigint, size bigint, node bigint, sketch binary, paths array<bigint>"
    )
    rows = docs.select("doc_id", id_key().alias("id"), text_key().alias("h"), "text")
    return arrow_map(rows, make, schema)


def _alike(sizes: np.ndarray, marks: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Pairs that sizes and sketches do not rule out."""
    a, b = sizes[i], sizes[j]
    ok = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    ok[ok] = _shares(marks, i[ok], j[ok]) >= SKETCH
    return ok


def _shares(marks: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Share of equal minima of the sketches ``i`` and ``j``, an estimate of their similarity."""
    both = (marks[i] | marks[j]) != 0
    same = (marks[i] == marks[j]) & both
    return same.sum(axis=1) / np.maximum(both.sum(axis=1), 1)


def _sketches(t: pa.Table) -> np.ndarray:
    raw = b"".join(t.column("sketch").to_pylist())
    return np.frombuffer(raw, dtype=np.uint8).reshape(-1, BINS)


def _node_pairs(percent: int, every: bool = False):
    """Pairs inside small nodes; without ``every`` those of two classes close to
    the first are left out, and ``close`` marks the pairs that stand for them."""

    def each(t: pa.Table, group: np.ndarray):
        node, size, marks = t.column("node").to_numpy(), t.column("size").to_numpy(), _sketches(t)
        a, b, marked = [], [], []
        rows = np.arange(len(group))
        first = np.searchsorted(group, group)
        close = _shares(marks, first, rows) >= CLOSE
        for step in range(1, len(group)):
            i = np.flatnonzero(group[step:] == group[:-step])
            if not len(i):
                break
            if not every:
                i = i[(first[i] == i) | ~(close[i] & close[i + step])]
            i = i[_alike(size, marks, i, i + step, percent)]
            a.append(node[i])
            b.append(node[i + step])
            marked.append((first[i] == i) & close[i + step])
        if a:
            yield {"a": np.concatenate(a), "b": np.concatenate(b), "close": np.concatenate(marked)}

    return each


def _similar(mine: np.ndarray, v: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough, exactly."""
    if 100 * min(len(mine), len(v)) < percent * max(len(mine), len(v)):
        return False
    at = np.searchsorted(mine, v)
    both = int((mine[np.minimum(at, len(mine) - 1)] == v).sum())
    return 100 * both >= percent * (len(mine) + len(v) - both)


def _block_links(percent: int):
    """Links that join components between two blocks of a large node.

    Odd members are tried with the others, the likeliest first; once a link is
    found the components count as one, and their members need no other.
    """

    def each(t: pa.Table, group: np.ndarray):
        node, size, marks = t.column("node").to_numpy(), t.column("size").to_numpy(), _sketches(t)
        part, odd, values = t.column("part").to_numpy(), t.column("odd").to_numpy(), t.column("values")
        roots, root = np.unique(t.column("root").to_numpy(), return_inverse=True)
        links = []
        for start in np.flatnonzero(np.r_[True, group[1:] != group[:-1]]):
            rows = np.arange(start, np.searchsorted(group, group[start], side="right"))
            first, second = rows[(part[rows] < 2) & odd[rows]], rows[part[rows] != 0]
            joined = np.arange(len(roots))  # each component's name in this block
            sets: dict[int, np.ndarray] = {}

            def full(i: int) -> np.ndarray:
                if i not in sets:
                    sets[i] = np.frombuffer(values[i].as_buffer(), dtype=np.uint64)
                return sets[i]

            for i in first:
                j = second[joined[root[second]] != joined[root[i]]]
                same = np.full(len(j), i)
                fine = _alike(size, marks, same, j, percent)
                j, same = j[fine], same[fine]
                j = j[np.argsort(-_shares(marks, same, j), kind="stable")]
                while len(j):
                    other = int(j[0])
                    if _similar(full(int(i)), full(other), percent):
                        links.append((node[i], node[other]))
                        joined[joined == joined[root[other]]] = joined[root[i]]
                        j = j[joined[root[j]] != joined[root[i]]]
                    else:
                        j = j[1:]
        if links:
            found = np.array(links, dtype=np.int64)
            yield {"a": found.min(axis=1), "b": found.max(axis=1)}

    return each


def _candidates(classes: DataFrame, ws: Workspace, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs ``a, b, close`` from small nodes and with hubs; the rows of nodes
    too large to compare; the members of the small nodes."""
    rows = classes.select(
        "node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)),
                          lambda t: F.slice("paths", t * DEPTH + 1, DEPTH))).alias("path")
    )
    small = []
    for d in range(DEPTH):
        # Only members of large nodes need the rest of their path.
        rows = rows.select("node", F.col("path")[0].alias("at"), F.slice("path", 2, DEPTH).alias("path"))
        sizes = rows.groupBy("at").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = rows.join(sizes, "at").withColumn("path", F.when(F.col("n") > LEAF, F.col("path")))
        rows = ws.stored(rows, f"level-{d}")
        small.append(rows.where(F.col("n") <= LEAF).select("at", "node"))
        rows = rows.where(F.col("n") > LEAF)
    large = rows.select("at", "n", "node")
    leaves = small[0].unionByName(small[1])
    for s in small[2:]:
        leaves = leaves.unionByName(s)
    pairs = _leaf_pairs(leaves, classes, percent)
    # Every member with the hub of one of its large nodes, the least by a hash.
    hubs = large.groupBy("at").agg(F.min_by("node", F.xxhash64("at", "node")).alias("hub"))
    stars = large.join(hubs, "at").groupBy(F.col("node").alias("a")).agg(F.min_by("hub", "at").alias("b"))
    return pairs.unionByName(stars.where("a != b").withColumn("close", F.lit(False))), large, leaves


def _leaf_pairs(leaves: DataFrame, classes: DataFrame, percent: int, every: bool = False) -> DataFrame:
    marks = classes.select("node", "size", "sketch")
    return grouped_map(
        leaves.join(marks, "node"), ["at"], ["node"], _node_pairs(percent, every), "a bigint, b bigint, close boolean"
    )


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "close")
    return pairs.groupBy("a", "b").agg(F.max("close").alias("close"))


def _left_out(
    pairs: DataFrame, links: DataFrame, leaves: DataFrame, classes: DataFrame, ws: Workspace, percent: int
) -> DataFrame | None:
    """Pairs that small nodes left out for a pair that was then not confirmed."""
    refused = ws.stored(pairs.where("close").join(links, ["a", "b"], "left_anti").select("a", "b"), "refused")
    if not refused.take(1):
        return None
    ends = refused.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    again = leaves.join(leaves.join(ends, "node", "left_semi").select("at").distinct(), "at", "left_semi")
    found = _distinct_pairs(_leaf_pairs(again, classes, percent, every=True)).select("a", "b")
    return ws.stored(found.join(pairs, ["a", "b"], "left_anti"), "left-out-pairs")


def _confirmed(pairs: DataFrame, sets: DataFrame, ws: Workspace, percent: int) -> DataFrame:
    """Of the distinct pairs ``(a, b)``, ``a < b``, those whose full sets are similar enough."""
    # The end with more pairs brings its set once for every TOGETHER of them.
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    d_a = degree.select(F.col("node").alias("a"), F.col("n").alias("n_a"))
    d_b = degree.select(F.col("node").alias("b"), F.col("n").alias("n_b"))
    turned = pairs.join(d_a, "a").join(d_b, "b").select(
        F.when(F.col("n_a") >= F.col("n_b"), F.col("a")).otherwise(F.col("b")).alias("hub"),
        F.when(F.col("n_a") >= F.col("n_b"), F.col("b")).otherwise(F.col("a")).alias("node"),
        F.greatest("n_a", "n_b").alias("n"),
    )
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / TOGETHER))
    turned = ws.stored(turned.withColumn("salt", salt), "turned-pairs")
    own = turned.select("hub", "salt").distinct().join(sets.withColumnRenamed("node", "hub"), "hub")
    other = turned.select("hub", "salt", "node").join(sets, "node")
    rows = own.select("hub", "salt", F.lit(None).cast("bigint").alias("node"), "values").unionByName(
        other.select("hub", "salt", "node", "values")
    )

    def each(t: pa.Table, group: np.ndarray):
        hub, node = t.column("hub").to_numpy(), t.column("node")
        values = t.column("values")
        a, b, mine = [], [], None
        for i in range(len(group)):
            v = np.frombuffer(values[i].as_buffer(), dtype=np.uint64)
            if not node[i].is_valid:
                mine = v
                continue
            if _similar(mine, v, percent):
                a.append(min(hub[i], node[i].as_py()))
                b.append(max(hub[i], node[i].as_py()))
        yield {"a": a, "b": b}

    return ws.stored(grouped_map(rows, ["hub", "salt"], ["node"], each, "a bigint, b bigint", 256), "links")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _sets(docs: DataFrame, classes: DataFrame, ends: DataFrame, ws: Workspace, k: int) -> DataFrame:
    """``node, values``: the full set of one document for each class in ``ends``."""
    wanted = classes.join(ends, "node").select("node", "id", "h")
    rows = docs.select(id_key().alias("id"), text_key().alias("h"), "text")
    rows = rows.join(ws.small(wanted, "wanted"), ["id", "h"]).select("node", "text")

    def make():
        def each(batch: pa.RecordBatch):
            for at, n in text_slices(batch.column(1), BATCH):
                some = batch.slice(at, n)
                sets = shingle_sets(some.column(1), k)
                yield {"node": some.column(0), "values": [s.tobytes() for s in sets]}

        return each

    found = arrow_map(rows, make, "node bigint, values binary")
    # A repeated row gives its class's set again.
    return ws.stored(found.groupBy("node").agg(F.first("values").alias("values")), "sets")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = SIMILARITY) -> DataFrame:
    """``doc_id, id, h, n_shingles, component_id, kept, stays``, one row per document.

    Links are pairs with ``100 * intersection >= percent * union``. ``id`` and
    ``h`` tell documents apart; ``stays`` is true for one of them in each
    component, also where ids are null or repeat.
    """
    with Workspace(docs.sparkSession) as ws, text_batches(docs.sparkSession):
        return ws.keep(_near_duplicates(docs, ws, k, percent), "near-duplicates")


def _near_duplicates(docs: DataFrame, ws: Workspace, k: int, percent: int) -> DataFrame:
    marked = ws.stored(signatures(docs, k), "signatures")
    full = marked.where(F.col("node").isNotNull())
    one = F.struct("id", "h", "size", "sketch", "paths")
    classes = full.groupBy("node").agg(F.min_by(one, F.struct("id", "h")).alias("one")).select("node", "one.*")
    classes = ws.stored(classes, "classes")
    pairs, large, leaves = _candidates(classes, ws, percent)
    pairs = ws.stored(_distinct_pairs(pairs), "candidates")
    sets = _sets(docs, classes, _ends(pairs), ws, k)
    links = _confirmed(pairs.select("a", "b"), sets, ws, percent)
    left_out = _left_out(pairs, links, leaves, classes, ws, percent)
    if left_out is not None:
        sets = _sets(docs, classes, _ends(left_out), ws, k)
        links = links.unionByName(_confirmed(left_out, sets, ws, percent))
    roots = components(ws, links)
    rest = _unsettled(docs, large, roots, classes, ws, k, percent)
    if rest is not None:
        roots = components(ws, links.unionByName(rest))
    own = marked.select("doc_id", "id", "h", F.col("size").alias("n_shingles"), "node")
    roots = ws.stored(roots, "roots")
    own = own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    one = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id"), F.col("id"), F.col("h"))
    least = own.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(one).alias("least"))
    out = own.join(least, "root", "left")
    alone = F.col("root").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id"))
    stays = alone | ((F.col("id") == F.col("least.id")) & (F.col("h") == F.col("least.h")))
    out = out.withColumns({"component_id": component, "stays": stays})
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return out.select("doc_id", "id", "h", "n_shingles", "component_id", kept, "stays")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = SIMILARITY) -> DataFrame:
    """The documents, one of each component; all columns stay.

    Of repeated rows one stays, if they have any word. Texts are only shuffled
    where rows repeat, unless the removed documents are too many to send to all.
    """
    with Workspace(docs.sparkSession) as ws, text_batches(docs.sparkSession):
        return ws.keep(_one_of_each(docs, ws, k, percent), "one-of-each")


def _one_of_each(docs: DataFrame, ws: Workspace, k: int, percent: int) -> DataFrame:
    id_, h = free_name(docs, "id"), free_name(docs, "h")
    found = ws.stored(_near_duplicates(docs, ws, k, percent), "near-duplicates")
    found = found.withColumnsRenamed({"id": id_, "h": h})
    gone = ws.small(found.where("not stays").select(id_, h).distinct(), "removed")
    times = found.where("stays and n_shingles > 0").groupBy(id_, h).agg(F.count(F.lit(1)).alias("times"))
    repeated = ws.small(times.where("times > 1").select(id_, h), "repeated-rows")
    rows = docs.withColumns({id_: id_key(), h: text_key()}).join(gone, [id_, h], "left_anti")
    single = rows.join(repeated, [id_, h], "left_anti")
    several = rows.join(repeated, [id_, h], "left_semi").dropDuplicates([id_, h])
    return single.unionByName(several).select(*docs.columns)


def _unsettled(
    docs: DataFrame, large: DataFrame, roots: DataFrame, classes: DataFrame, ws: Workspace, k: int, percent: int
) -> DataFrame | None:
    """Links between components in nodes that were only compared with hubs."""
    if not large.take(1):
        return None
    rows = large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = ws.stored(rows, "large-rooted")
    by_root = rows.groupBy("at", "root").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"))
    most = by_root.groupBy("at").agg(F.max_by("root", F.struct("k", "root")).alias("most"), F.max("k").alias("k"), F.max("n").alias("n"))
    most = ws.small(most.where("k < n").select("at", "most"), "unsettled-nodes")
    rows = rows.join(most, "at").withColumn("odd", F.col("root") != F.col("most"))
    rows = ws.stored(rows.join(classes.select("node", "size", "sketch"), "node"), "unsettled")
    if not rows.take(1):
        return None
    # Blocks of a bounded number of shingles; hashed, so about equally large.
    totals = rows.groupBy("at").agg(
        F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks"),
        F.ceil(F.sum(F.when(F.col("odd"), F.col("size"))) / BLOCK).cast("int").alias("odd_blocks"),
    )
    rows = rows.join(ws.small(totals, "block-counts"), "at")
    sets = _sets(docs, classes, rows.select("node").distinct(), ws, k)
    hash_ = F.xxhash64("node")
    own = F.when(F.col("odd"), F.pmod(hash_, F.col("odd_blocks")))
    one = F.pmod(hash_, F.col("blocks"))
    # A member meets every block of odd members; an odd one every block of members.
    as_member = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("odd_blocks") - 1)).alias("x"), one.alias("y"))
    as_odd = rows.where("odd").select("*", own.alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"))
    columns = ["at", "x", "y", "node", "root", "odd", "size", "sketch"]
    both = as_member.select(*columns, F.lit(2).alias("part")).unionByName(as_odd.select(*columns, F.lit(0).alias("part")))
    links = grouped_map(
        both.join(sets, "node"), ["at", "x", "y"], ["part", "node"], _block_links(percent), "a bigint, b bigint", 512
    )
    links = ws.stored(links.distinct(), "rest")
    return links if links.take(1) else None
