"""Approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node. Nodes lie in bands by the power of two of their
norm, and in shards of a band by a hash, ``SHARD`` nodes each, so that a
shard's graph fits a task whatever the table's size, and a few long vectors do
not hide the differences of the others.

Building: a few sorted projection passes give every node first neighbours;
equal codes are ordered by one more projection, another in each pass.
Then each round joins neighbours of neighbours: a node's list goes to those in
it and to a sample of those that have the node in theirs, every such group
compares its new members with all, and whoever is nearer than a node's worst
neighbour replaces it. Groups are bounded by the sample; the edges are a table
of one row each, written after every round.

Searching: a task loads one shard's graph and lets queries stream past it. Each
is searched greedily: the best ``EXPAND`` unexpanded nodes of a beam are
replaced by their neighbours until none is left. A shard's graph is copied only
as often as it takes to have ``COPIES`` groups for each task, never more for
more queries. All shards' beams are merged, and the scores of what is returned
are computed anew in double precision from the original vectors.

Nearness is the inner product. For vectors of different norm the graph is built
with one more component that brings all of a band to its largest norm, which
keeps the order of inner products for any query. Components keep the precision
they have in the table and are multiplied in double precision, so near copies
are told apart wherever their scores differ.

Cases: a vector that is null, empty, zero, or holds a null, infinite or
undefined component takes no part, neither as query nor as candidate; shorter
vectors count as padded with zeros; equal scores are ordered by id; rows that
repeat an id with equal vectors are one candidate per row; a query's own id is
never its candidate; a null id is a candidate but no query; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from pairforge.llm.common import Workspace, arrow_map, arrow_schema, column, grouped_map, partitions, record, ship
from pairforge.llm.embed_dedup import usable

SHARD = 65_536
NEIGHBOURS = 40
#: First neighbours: passes, rows compared together, neighbours kept of each pass.
PASSES, TOGETHER, FIRST = 8, 256, 12
ROUNDS = 5
#: Neighbours, and nodes that have the node as neighbour, in one group.
SAMPLE = 20
BEAM = 224
EXPAND = 32
QUERIES = 512
COPIES = 3
ENTRIES = 1_024
SEED = 3


class Form(NamedTuple):
    """How vectors are stored: components of this kind, then one added double."""

    dims: int
    kind: str
    shards: int

    def split(self, raw: list) -> tuple[np.ndarray, np.ndarray]:
        """Components, and the added ones."""
        width = self.dims * np.dtype(self.kind).itemsize
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(len(raw), width + 8)
        return np.ascontiguousarray(flat[:, :width]).view(self.kind), np.ascontiguousarray(flat[:, width:]).view("f8")

    def rows(self, raw: list) -> np.ndarray:
        """Vectors with the added component, in double precision."""
        return np.hstack([x.astype(np.float64) for x in self.split(raw)])


def _nodes(vectors: DataFrame, ws: Workspace) -> tuple[DataFrame, Form]:
    """``node, shard, vec``: distinct vectors, and the form of ``vec``."""
    kind = "f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "f8"
    fine = vectors.where(usable()).select(F.col("embedding").cast("array<double>").alias("embedding"))
    distinct = fine.groupBy(F.xxhash64("embedding").alias("node")).agg(F.first("embedding").alias("embedding"))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    # Borders lie between powers of two, so that unit vectors are all in one band.
    band = F.coalesce(F.floor(F.log2(F.sqrt(square)) + 0.5), F.lit(-(1 << 20)))
    distinct = ws.stored(distinct.withColumn("square", square).withColumn("band", band), "distinct-vectors")
    counts = distinct.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.max("square").alias("top"), F.max(F.size("embedding")).alias("dims")
    )
    # One row per power of two that a double can have, some 2,000 at most.
    bands, total = {}, 0
    counted = counts.orderBy("band").collect()
    for r in counted:
        own = -(-r.n // SHARD)
        bands[r.band] = (total, own, r.top)
        total += own
    form = Form(max((r.dims for r in counted), default=0), kind, max(1, total))

    def make():
        def each(batch: pa.RecordBatch):
            node, lists = batch.column(0).to_numpy(), batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            x = np.zeros((len(size), form.dims))
            values = lists.flatten().to_numpy()
            x[np.repeat(np.arange(len(size)), size), np.concatenate([np.arange(s) for s in size])] = values
            x = x.astype(form.kind)
            first, own, top = (np.array(v) for v in zip(*(bands[b] for b in batch.column(3).to_pylist())))
            with np.errstate(over="ignore", invalid="ignore"):
                gap = top - (x.astype(np.float64) ** 2).sum(axis=1)
            added = np.sqrt(np.maximum(0.0, np.nan_to_num(gap)))
            yield {
                "node": node, "shard": first + node % own,
                "vec": [v.tobytes() + a.tobytes() for v, a in zip(x, added)],
            }

        return each

    return ws.stored(arrow_map(distinct, make, "node bigint, shard bigint, vec binary"), "nodes"), form


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each node; an edge seen before is not new again."""
    one = edges.groupBy("node", "to").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    order = Window.partitionBy("node").orderBy(F.desc("sim"), "to")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _first_edges(nodes: DataFrame, form: Form) -> DataFrame:
    """Nearest in sorted blocks of several random projections."""

    def make_code():
        def each(batch: pa.RecordBatch):
            x = form.rows(batch.column(2).to_pylist())
            places = np.int64(1) << np.arange(59, -1, -1, dtype=np.int64)
            for k in range(PASSES):
                planes = np.random.default_rng([SEED, k]).standard_normal((form.dims + 1, 61))
                at = x @ planes
                yield {
                    "pass": np.full(len(x), k), "shard": batch.column(1), "code": (at[:, :60] > 0) @ places,
                    "line": np.nan_to_num(at[:, 60]), "node": batch.column(0), "vec": batch.column(2),
                }

        return each

    codes = arrow_map(nodes, make_code, "pass int, shard bigint, code bigint, line double, node bigint, vec binary")
    order = ["pass", "shard", "code", "line", "node"]
    laid = codes.repartitionByRange(partitions(nodes.sparkSession), *order).sortWithinPartitions(*order)

    def make():
        def each(batch: pa.RecordBatch):
            key = batch.column(0).to_numpy().astype(np.int64) * (1 << 40) + batch.column(1).to_numpy()
            node, vec = batch.column(4).to_numpy(), batch.column(5)
            cuts = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)]
            for a, b in zip(cuts, cuts[1:]):
                for at in range(a, b, TOGETHER):
                    at = max(a, min(at, b - TOGETHER))  # the last block is as long as the others
                    own = node[at : min(at + TOGETHER, b)]
                    if len(own) < 2:
                        continue
                    x = form.rows(vec.slice(at, len(own)).to_pylist())
                    s = x @ x.T
                    np.fill_diagonal(s, -np.inf)
                    k = min(FIRST, len(own) - 1)
                    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    yield {
                        "node": np.repeat(own, k), "to": own[near].ravel(),
                        "sim": np.take_along_axis(s, near, axis=1).ravel(),
                        "new": np.ones(len(own) * k, dtype=bool),
                    }

        return each

    return arrow_map(laid, make, "node bigint, to bigint, sim double, new boolean")


def _sampled(edges: DataFrame, centre: str, member: str, turn: int) -> DataFrame:
    """Up to ``SAMPLE`` members of each centre, new ones first in most draws."""
    draw = F.pmod(F.xxhash64("node", "to", F.lit(turn)), F.lit(1000)) - F.when(F.col("new"), 700).otherwise(0)
    order = Window.partitionBy(centre).orderBy(draw, member)
    rows = edges.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SAMPLE)
    return rows.select(F.col(centre).alias("centre"), F.col(member).alias("member"), "new")


def _round(edges: DataFrame, nodes: DataFrame, form: Form, turn: int, ws: Workspace) -> DataFrame:
    """One round of joining neighbours of neighbours."""
    forward = ws.stored(_sampled(edges, "node", "to", turn), "forward")
    both = forward.unionByName(_sampled(edges, "to", "node", turn))
    groups = both.groupBy("centre", "member").agg(F.max("new").alias("new"))
    worst = edges.groupBy("node").agg(
        F.when(F.count(F.lit(1)) >= NEIGHBOURS, F.min("sim")).otherwise(F.lit(float("-inf"))).alias("worst")
    )
    known = nodes.join(worst, "node", "left").select(
        F.col("node").alias("member"), "vec", F.coalesce("worst", F.lit(float("-inf"))).alias("worst")
    )
    rows = groups.join(known, "member")

    def each(t: pa.Table, group: np.ndarray):
        member, new, worst = (t.column(c).to_numpy() for c in ("member", "new", "worst"))
        x = form.rows(t.column("vec").to_pylist())
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        found: list[list] = [[], [], []]
        for a, b in zip(starts, [*starts[1:], len(group)]):
            fresh = new[a:b]
            if not fresh.any():
                continue
            s = x[a:b] @ x[a:b].T
            np.fill_diagonal(s, -np.inf)
            i, j = np.nonzero((s > worst[a:b, None]) & (fresh[:, None] | fresh[None, :]))
            for out, v in zip(found, (member[a + i], member[a + j], s[i, j])):
                out.append(v)
        if found[0]:
            node, to, sim = (np.concatenate(v) for v in found)
            yield {"node": node, "to": to, "sim": sim, "new": np.ones(len(node), dtype=bool)}

    better = grouped_map(
        rows, ["centre"], ["member"], each, "node bigint, to bigint, sim double, new boolean"
    )
    # Those that were in a group now have met; the others stay new.
    met = forward.where("new").select(F.col("centre").alias("node"), F.col("member").alias("to"), F.lit(True).alias("met"))
    old = edges.select("node", "to", "sim", "new").join(met, ["node", "to"], "left")
    old = old.select("node", "to", "sim", (F.col("new") & F.col("met").isNull()).alias("new"))
    return _best(old.unionByName(better), NEIGHBOURS)


def build(vectors: DataFrame, ws: Workspace, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, Form]:
    """Nodes, edges ``(node, to, sim)`` of the neighbour graph, and the vectors' form."""
    nodes, form = _nodes(vectors, ws)
    edges = ws.stored(_best(_first_edges(nodes, form), NEIGHBOURS), "edges")
    for turn in range(rounds):
        edges = ws.stored(_round(edges, nodes, form, turn, ws), "edges")
    return nodes, edges, form


def _adjacent(edges: DataFrame) -> DataFrame:
    """``node, near``: neighbours, and up to as many nodes that have the node as neighbour."""
    order = Window.partitionBy("to").orderBy(F.desc("sim"), "node")
    back = edges.withColumn("place", F.row_number().over(order)).where(F.col("place") <= NEIGHBOURS)
    both = edges.select("node", "to").union(back.select("to", "node")).distinct()
    return both.groupBy("node").agg(F.collect_list("to").alias("near"))


def greedy(x: np.ndarray, near: np.ndarray, query: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Places of the beam, best first. ``near`` is padded with -1."""

    def scores(places):
        return x[places].astype(np.float64) @ query

    seen = np.zeros(len(x), dtype=bool)
    seen[start] = True
    beam, score = start, scores(start)
    done = np.zeros(len(beam), dtype=bool)
    while True:
        order = np.argsort(-score, kind="stable")[:BEAM]
        beam, score, done = beam[order], score[order], done[order]
        turn = np.flatnonzero(~done)[:EXPAND]
        if not len(turn):
            return beam
        done[turn] = True
        found = near[beam[turn]].ravel()
        found = found[found >= 0]
        found = np.unique(found[~seen[found]])
        seen[found] = True
        beam = np.r_[beam, found]
        score = np.r_[score, scores(found)]
        done = np.r_[done, np.zeros(len(found), dtype=bool)]


class Graph:
    """A shard's graph inside a task; its rows come sorted by node."""

    def __init__(self, rows: pa.Table, form: Form):
        self.form = form
        self.ids = rows.column("node").to_numpy()
        self.x, _ = form.split(rows.column("vec").to_pylist())
        lists = rows.column("near").combine_chunks()
        degree = np.diff(lists.offsets.to_numpy())
        self.near = np.full((len(self.ids), max(1, int(degree.max()))), -1, dtype=np.int32)
        owner = np.repeat(np.arange(len(degree)), degree)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(degree) - degree, degree)
        self.near[owner, place] = np.searchsorted(self.ids, lists.flatten().to_numpy())
        self.entries = np.unique(np.linspace(0, len(self.ids) - 1, ENTRIES).astype(np.int64))

    def search(self, names: np.ndarray, raw: list, keep: int) -> dict:
        asked, found = [], []
        # The added component is the data's only.
        for name, query in zip(names, self.form.split(raw)[0].astype(np.float64)):
            own = int(np.searchsorted(self.ids, name))
            start = self.entries
            if own < len(self.ids) and self.ids[own] == name:
                start = np.union1d(start, [own])
            beam = greedy(self.x, self.near, query, start)[:keep]
            asked.append(np.full(len(beam), name))
            found.append(self.ids[beam])
        return {"query": np.concatenate(asked), "node": np.concatenate(found)}


def search(
    queries: DataFrame, nodes: DataFrame, edges: DataFrame, form: Form, ws: Workspace, keep: int
) -> DataFrame:
    """``query, node``: the ``keep`` best nodes of each shard for ``queries`` of ``query, vec``.

    A query that is itself a node starts there too; all start at the best of
    ``ENTRIES`` nodes.
    """
    tasks = partitions(nodes.sparkSession)
    graph = ws.stored(nodes.join(_adjacent(edges), "node", "left"), "graph")
    salts = max(1, min(-(-queries.count() // QUERIES), -(-COPIES * tasks // form.shards)))
    asked = queries.select(
        F.pmod(F.xxhash64("query"), F.lit(salts)).alias("salt"), F.lit(1).alias("kind"), F.col("query").alias("node"),
        "vec", F.lit(None).cast("array<bigint>").alias("near"),
    )
    # The stated queries against every shard.
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(form.shards - 1))))
    copies = graph.select(
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "node", "vec", "near",
        "shard",
    )
    dealt = copies.unionByName(asked).repartition(tasks, "shard", "salt")
    dealt = dealt.sortWithinPartitions("shard", "salt", "kind", "node")
    kinds = arrow_schema("query bigint, node bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, graph = None, [], None
        for batch in batches:
            columns = [column(batch, c) for c in ("shard", "salt", "kind")]
            new = np.zeros(max(0, batch.num_rows - 1), dtype=bool)
            for c in columns:
                new |= c[1:] != c[:-1]
            cuts = np.r_[0, np.flatnonzero(new) + 1, batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                own = (columns[0][a], columns[1][a])
                if own != group:
                    group, rows, graph = own, [], None
                part = batch.slice(a, b - a)
                if columns[2][a] == 0:
                    rows.append(part)
                    continue
                if rows:
                    graph, rows = Graph(pa.Table.from_batches(rows), form), []
                if graph:
                    raw = part.column(part.schema.get_field_index("vec")).to_pylist()
                    yield record(graph.search(column(part, "node"), raw, keep), kinds)

    ship(nodes.sparkSession)
    return dealt.mapInArrow(run, "query bigint, node bigint")


def nearest(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each query row.

    ``is_query`` is a condition on the rows.
    """
    with Workspace(vectors.sparkSession) as ws:
        return ws.keep(_nearest(vectors, is_query, k, ws), "nearest")


def _nearest(vectors: DataFrame, is_query, k: int, ws: Workspace) -> DataFrame:
    rows = vectors.withColumn("asks", F.coalesce(is_query, F.lit(False)) & F.col("vec_id").isNotNull())
    rows = rows.where(usable()).select(
        "vec_id", "asks", F.col("embedding").cast("array<double>").alias("x"),
        F.xxhash64(F.col("embedding").cast("array<double>")).alias("node"),
    )
    rows = ws.stored(rows, "vectors")
    nodes, edges, form = build(vectors.select("embedding"), ws)
    asked = rows.where("asks").select(F.col("node").alias("query")).distinct()
    queries = asked.join(nodes.select(F.col("node").alias("query"), "vec"), "query")
    # A node more than asked for, as the query's own may be among them, and room for rounding.
    found = ws.stored(search(ws.stored(queries, "queries"), nodes, edges, form, ws, 2 * k + 1), "found")
    vector = rows.groupBy("node").agg(F.first("x").alias("x"))
    scored = found.join(vector.withColumnRenamed("node", "query").withColumnRenamed("x", "q"), "query")
    scored = scored.join(vector, "node").select("query", "node", _inner("q", "x").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    scored = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 2 * k + 1)
    # Of equal vectors the smallest ids decide, and one more for the query itself.
    ids = Window.partitionBy("node").orderBy(F.col("vec_id").asc_nulls_last())
    members = rows.withColumn("place", F.row_number().over(ids)).where(F.col("place") <= k + 1).select("node", "vec_id")
    candidates = ws.stored(scored.select("query", "node", "score").join(members, "node"), "candidates")
    top = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    best = candidates.withColumn("place", F.row_number().over(top)).where(F.col("place") <= k + 1)
    own = rows.where("asks").select(F.col("vec_id").alias("query_id"), F.col("node").alias("query"))
    out = own.join(best, "query").where(~F.col("vec_id").eqNullSafe(F.col("query_id")))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    out = out.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def _inner(a: str, b: str):
    """Inner product in double precision, over the components that both have."""
    both = F.transform(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b")), lambda z: z["a"] * z["b"])
    return F.aggregate(both, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
