"""Removal of long repeated strings with a logarithmic family of suffix arrays.

Every string of ``LENGTH`` bytes has an anchor: the leftmost of its ``SEED``-byte
grams with the least hash. Equal strings have their anchors at the same place,
so suffixes that start at anchors are enough, one in some 70 bytes. A suffix array
here is a table of such suffixes in the order of their first ``SEED`` bytes, in
files that follow each other, and of equal ones by a 64-bit fingerprint of the
whole stretch of strings that share the anchor.

Documents come in ``BATCHES`` batches. Each gets its array, which is merged with
all existing levels into one order, range by range, and scanned: neighbours with
equal bytes are matches. A scan keeps one suffix in memory, whatever the number
of equal ones, and a run of equal suffixes may reach over many ranges: what the
ends of a range leave open is settled by counts of the two ends of all ranges.
Then the array becomes a level of one batch, and two levels of equal size merge
when there are such. Each suffix is reported once, by the scan that first finds
another like it. Levels and reports lie in a folder: a family that is opened on
it again goes on from there.

What remains is exact and small: suffixes with a repeated anchor fall into
classes of equal stretches. A class with two members is repeated as a whole.
Where one anchor has several classes, each string of a class is compared with
the strings of the other classes by position and fingerprint, up to ``GROUP``
classes inside one task, more by counts that are summed before they are
shuffled. A passage with many copies is one class, and no pairs are made.

Cases: null and empty texts, and texts under ``LENGTH`` bytes, lose nothing;
overlapping repeats inside one text count; rows that repeat are documents of
their own, so both lose what they share; documents are joined by a 64-bit hash
of id and text; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairforge.llm.common import (
    Workspace, arrow_map, arrow_schema, free_name, give_back, grouped_map, id_key, mix, partitions, record, seeds, ship,
    text_batches, text_key, text_slices,
)

LENGTH = 200
SEED = 32
BATCHES = 4
#: String starts that are looked at together.
CHUNK = 1 << 18
#: Bytes of text that are written again together, or one text.
SLICE = 1 << 20
#: Odd base of the rolling hash (any odd number does).
BASE = 0x9E3779B97F4A7C15

#: Classes of one anchor that are compared in one task; more are compared by shuffled counts.
#: A context has under 460 bytes and 256 strings; with 169 strings each a group takes 73 MB.
GROUP = 4_096

#: ``place`` holds the anchor's position, and how far before it the first and
#: the last string of the stretch start, in 48, 8 and 8 bits.
ARRAY = "key binary, ext bigint, doc bigint, place bigint"
#: A scan's rows: reported, the counts at an end of a range, and a suffix these decide on.
FOUND = ARRAY + ", old bigint, new bigint, kind int"
SURE, COUNTS, OPEN = 0, 1, 2
FAR = "(shiftright(place, 8) & 255)"
FIRST = f"(shiftright(place, 16) - {FAR})"
LAST = "(shiftright(place, 16) - (place & 255))"


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value of each byte, powers of the base, and of its inverse."""
    n = CHUNK + LENGTH + 1
    with np.errstate(over="ignore"):
        base, inverse = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
        base[0] = inverse[0] = 1
        return seeds(256, 5), np.cumprod(base, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)


class Rolling:
    """Hashes of any substring of a buffer of at most ``CHUNK + LENGTH`` bytes."""

    def __init__(self, data: np.ndarray):
        values, powers, self.inverse = _tables()
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values[data] * powers[: len(data)], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def anchors(data: np.ndarray, room: np.ndarray, length: int, seed: int):
    """Anchor, first and last start of each stretch of strings with one anchor.

    ``room`` has for each byte how many bytes its document has from there on.
    Returns also the fingerprint of the stretch.
    """
    n, width = len(data), length - seed + 1
    if n < length:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    roll = Rolling(data)
    grams = n - seed + 1
    hashes = mix((roll.sums[seed:] - roll.sums[:grams]) * roll.inverse[:grams])
    # The least hash, and of equal ones the leftmost: upper bits and place in one number.
    keys = (hashes & ~np.uint64((1 << 24) - 1)) | np.arange(grams, dtype=np.uint64)
    blocks = np.full((-(-grams // width) * width), ~np.uint64(0))
    blocks[:grams] = keys
    blocks = blocks.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    low = np.minimum(behind[:starts], before[width - 1 : width - 1 + starts])
    start = np.flatnonzero(room[:starts] >= length)
    if not len(start):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    anchor = (low[start] & np.uint64((1 << 24) - 1)).astype(np.int64)
    cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(start) != 1)) + 1
    first, last = np.r_[0, cut], np.r_[cut, len(start)] - 1
    anchor, lo, hi = anchor[first], start[first], start[last]
    shape = ((anchor - hi) << 16 | (anchor - lo)).astype(np.uint64)
    ext = mix(roll.of(lo, hi + length) ^ mix(shape + np.uint64(1)))
    return anchor, lo, hi, ext.view(np.int64)


def buffers(raws: list, length: int):
    """Texts joined to buffers: ``data, room, owner of each text part, its start in buffer and text``.

    Longer texts are cut so that every string lies whole in one buffer.
    """
    data: list[np.ndarray] = []
    parts: list[tuple[int, int, int]] = []
    total = 0

    def out():
        sizes = [len(d) for d in data]
        room = np.concatenate([np.arange(s, 0, -1) for s in sizes])
        return np.concatenate(data), room, parts

    for owner, raw in enumerate(raws):
        text = np.frombuffer(raw, dtype=np.uint8)
        for at in range(0, len(text), CHUNK):
            piece = text[at : at + CHUNK + length - 1]
            if len(piece) < length:
                continue
            if total and total + len(piece) > CHUNK:
                yield out()
                data, parts, total = [], [], 0
            parts.append((owner, total, at))
            data.append(piece)
            total += len(piece)
    if data:
        yield out()


def _documents(docs: DataFrame) -> DataFrame:
    """``doc_id, doc, raw``: the key of a document and its text in bytes."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", F.xxhash64(id_key(), text_key()).alias("doc"), raw.alias("raw"))


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as an Arrow column."""
    n, width = rows.shape
    ends = pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int64))
    data = pa.py_buffer(np.ascontiguousarray(rows))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, ends, data])


def _bytes(column: pa.Array) -> np.ndarray:
    """The same column, of values of one length, as rows of bytes."""
    raw = column.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    return np.frombuffer(raw.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].reshape(len(raw), -1)


def suffixes(rows: DataFrame, length: int, seed: int) -> DataFrame:
    """The anchored suffixes of the texts ``doc, raw``."""

    if not 0 <= length - seed < 256:
        raise ValueError("a string may be up to 255 bytes longer than its anchor")

    def make():
        def each(batch: pa.RecordBatch):
            docs = batch.column(0).to_numpy()
            for data, room, parts in buffers([r.as_buffer() for r in batch.column(1)], length):
                anchor, lo, hi, ext = anchors(data, room, length, seed)
                owner, base, shift = (np.array(x) for x in zip(*parts))
                part = np.searchsorted(base, anchor, side="right") - 1
                yield {
                    "key": _binary(data[anchor[:, None] + np.arange(seed)]), "ext": ext, "doc": docs[owner[part]],
                    "place": (anchor - base[part] + shift[part]) << 16 | (anchor - lo) << 8 | (anchor - hi),
                }

        return each

    return arrow_map(rows, make, ARRAY)


def in_order(array: DataFrame, *after_key: str) -> DataFrame:
    """Dealt out in ranges of the suffixes' order and sorted; equal suffixes may lie in several ranges."""
    order = ["key", *after_key, "ext", "doc", "place"]
    return array.repartitionByRange(partitions(array.sparkSession), *order).sortWithinPartitions(*order)


class MergeScan:
    """One pass over suffixes in order, of equal ones those of levels before new ones.

    Reports every new suffix that has an equal one, and one of a level if its
    only equal ones are new. The first and the last run of equal suffixes may
    go on in other ranges, so they leave their counts, and the one suffix, if
    any, that the counts of all ranges decide on.
    """

    def __init__(self, kinds: pa.Schema):
        self.kinds = kinds
        self.key: bytes | None = None
        self.first = True
        self.old = self.new = 0
        self.waiting: pa.RecordBatch | None = None

    def rows(self, part: pa.RecordBatch, kind: int = SURE, old: int = 0, new: int = 0) -> pa.RecordBatch:
        n = part.num_rows
        own = {c: part.column(c) for c in ("key", "ext", "doc", "place")}
        return record(own | {"old": np.full(n, old), "new": np.full(n, new), "kind": np.full(n, kind)}, self.kinds)

    def step(self, batch: pa.RecordBatch):
        keys, new = _bytes(batch.column("key")), batch.column("new").to_numpy() == 1
        start = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        end = np.r_[start[1:], len(new)]
        n_new = np.add.reduceat(new.astype(np.int64), start)
        n_old = end - start - n_new
        # Runs that lie within the batch at once, its first and last one by one.
        inner = np.ones(len(start), dtype=bool)
        inner[[0, -1]] = False
        run = np.repeat(np.arange(len(start)), end - start)
        hit = np.where(new, (n_old + n_new > 1)[run], ((n_old == 1) & (n_new > 0))[run])
        at = np.flatnonzero(hit & inner[run])
        if len(at):
            yield self.rows(batch.take(pa.array(at)))
        for g in sorted({0, len(start) - 1}):
            key = keys[start[g]].tobytes()
            if key != self.key:
                yield from self.close(False)
                self.key, self.old, self.new = key, 0, 0
            yield from self.feed(batch.slice(start[g], end[g] - start[g]), int(n_old[g]), int(n_new[g]))

    def feed(self, part: pa.RecordBatch, n_old: int, n_new: int):
        """More suffixes of the current run."""
        self.old += n_old
        self.new += n_new
        if n_old:
            self.waiting = part.slice(0, 1) if self.old == 1 else None
        if n_new and self.old + self.new == 1:
            self.waiting = part.slice(0, 1)
        elif n_new:
            if self.waiting is not None and not self.old:
                yield self.rows(self.waiting)
                self.waiting = None
            yield self.rows(part.slice(n_old))

    def close(self, at_end: bool):
        """The current run is over, in this range."""
        if self.key is None:
            return
        if self.first or at_end:
            whole = pa.RecordBatch.from_pydict({"key": [self.key], "ext": [0], "doc": [0], "place": [0]})
            yield self.rows(whole, COUNTS, self.old, self.new)
            if self.waiting is not None:
                yield self.rows(self.waiting, OPEN, int(self.old > 0), int(self.old == 0))
        elif self.waiting is not None and self.old and self.new:
            yield self.rows(self.waiting)
        self.first, self.waiting = False, None


class SuffixFamily:
    """Levels of suffix arrays in a folder; a level's size is the number of its batches.

    Without ``folder`` they lie in the workspace and go with it. A folder of
    the caller keeps the levels, all reports, and a manifest with the levels
    after each batch; ``again`` goes on with the last of them.
    """

    def __init__(
        self, ws: Workspace, length: int = LENGTH, seed: int = SEED, folder: str | None = None, again: bool = False
    ):
        self.ws, self.length, self.seed = ws, length, seed
        self.folder = (folder or ws.path("suffix-family")).rstrip("/")
        self.batches = 0
        self.levels: list[tuple[int, str]] = []
        if again:
            rows = ws.spark.read.schema("batches int, size int, name string").json(f"{self.folder}/manifest")
            last = rows.where(F.col("batches") == rows.agg(F.max("batches")).first()[0]).collect()
            self.batches = last[0].batches
            self.levels = sorted(((r.size, r.name) for r in last), reverse=True)

    def level(self, name: str) -> DataFrame:
        return self.ws.spark.read.schema(ARRAY).parquet(f"{self.folder}/{name}")

    def add(self, rows: DataFrame, last: bool = False) -> None:
        """Take in the texts ``doc, raw`` of a batch.

        Unless it is the ``last``, levels of equal size are merged afterwards.
        """
        b = self.batches
        loose = f"{self.folder}/loose-{b}"
        with text_batches(self.ws.spark):
            array = self.ws.stored(suffixes(rows, self.length, self.seed), "suffixes", at=loose)
        array = self.ws.stored(in_order(array), "array", at=f"{self.folder}/level-{b}-{b}")
        self.ws.delete(loose)
        merged = array.withColumn("new", F.lit(1))
        for _, name in self.levels:
            merged = merged.unionByName(self.level(name).withColumn("new", F.lit(0)))
        found = self.ws.stored(self._scanned(in_order(merged, "new")), "found", "kind", at=f"{self.folder}/found-{b}")
        counts = found.where(F.col("kind") == COUNTS).groupBy("key")
        counts = counts.agg(F.sum("old").alias("all_old"), F.sum("new").alias("all_new"))
        open_ = found.where(F.col("kind") == OPEN).join(counts, "key")
        open_ = open_.where("(old = 1 and all_old = 1 and all_new > 0) or (new = 1 and all_old + all_new > 1)")
        self.ws.stored(open_.select("key", "ext", "doc", "place"), "at-ends", at=f"{self.folder}/ends-{b}")
        self.levels.append((1, f"level-{b}-{b}"))
        gone = []
        while not last and len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, x), (m, y) = self.levels.pop(), self.levels.pop()
            name = f"level-{b + 1 - n - m}-{b}"
            both = self.level(x).unionByName(self.level(y))
            self.ws.stored(in_order(both), "level", at=f"{self.folder}/{name}")
            self.levels.append((n + m, name))
            gone += [x, y]
        self.batches += 1
        manifest = [(self.batches, n, name) for n, name in self.levels]
        manifest = self.ws.spark.createDataFrame(manifest, "batches int, size int, name string")
        manifest.coalesce(1).write.mode("append").json(f"{self.folder}/manifest")
        for name in gone:
            self.ws.delete(f"{self.folder}/{name}")

    def _scanned(self, rows: DataFrame) -> DataFrame:
        kinds = arrow_schema(FOUND)

        def run(batches):
            scan = MergeScan(kinds)
            for batch in batches:
                if batch.num_rows:
                    yield from scan.step(batch)
            yield from scan.close(True)
            scan = batch = None
            give_back()

        ship(rows.sparkSession)
        return rows.mapInArrow(run, FOUND)

    def found(self) -> DataFrame:
        """``fp, ext, doc, place`` of all suffixes so far that have an equal one, each once."""
        read, out = self.ws.spark.read, None
        for b in range(self.batches):
            sure = read.schema(FOUND).parquet(f"{self.folder}/found-{b}").where(F.col("kind") == SURE)
            ends = read.schema(ARRAY).parquet(f"{self.folder}/ends-{b}")
            both = sure.select("key", "ext", "doc", "place").unionByName(ends)
            out = both if out is None else out.unionByName(both)
        return out.select(F.xxhash64("key").alias("fp"), "ext", "doc", "place")


def _contexts(docs: DataFrame, members: DataFrame, ws: Workspace, length: int) -> DataFrame:
    """``fp, k, single, doc, first, far, size, raw``: all strings of one member of each class."""
    wanted = members.groupBy("doc").agg(F.collect_list(F.struct("fp", "k", "single", "first", "far", "size")).alias("wanted"))
    rows = _documents(docs).select("doc", "raw").join(ws.stored(wanted, "class-members").hint("merge"), "doc")

    def make():
        def each(batch: pa.RecordBatch):
            for doc, raw, list_ in zip(*(batch.column(i) for i in range(3))):
                text, want = memoryview(raw.as_buffer()), list_.values
                names = ("fp", "k", "single", "first", "far", "size")
                out = {c: want.field(i) for i, c in enumerate(names)}
                ends = zip(out["first"].to_pylist(), out["size"].to_pylist())
                yield out | {
                    "doc": np.full(len(want), doc.as_py()),
                    "raw": [bytes(text[a : a + n + length - 1]) for a, n in ends],
                }

        return each

    schema = "fp bigint, k bigint, single boolean, doc bigint, first bigint, far int, size int, raw binary"
    with text_batches(ws.spark):
        return ws.stored(arrow_map(rows, make, schema), "contexts")


def _hashes(raws: list[bytes], size: np.ndarray, length: int):
    """Row, number and hash of each string of the contexts."""
    row = np.repeat(np.arange(len(size)), size)
    step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    base = np.cumsum(size + length - 1) - (size + length - 1)
    keys = []
    for part in np.split(np.arange(len(size)), np.flatnonzero(np.diff(base // (CHUNK // 2))) + 1):
        if len(part):
            own = (row >= part[0]) & (row <= part[-1])
            start = base[row[own]] - base[part[0]] + step[own]
            data = np.frombuffer(b"".join(raws[part[0] : part[-1] + 1]), dtype=np.uint8)
            keys.append(Rolling(data).of(start, start + length))
    return row, step, np.concatenate(keys)


def _compared(contexts: DataFrame, length: int) -> DataFrame:
    """``doc, first, last``: strings that another class of the same anchor has, group by group."""

    def part(t: pa.Table, group: np.ndarray) -> dict | None:
        size, far, single, doc, first = (
            t.column(c).to_numpy().astype(np.int64) for c in ("size", "far", "single", "doc", "first")
        )
        row, step, key = _hashes(t.column("raw").to_pylist(), size, length)
        place = (group[row] << 9 | (far[row] - step)).astype(np.uint64)
        _, of_key, times = np.unique(mix(key ^ mix(place)), return_inverse=True, return_counts=True)
        hit = np.flatnonzero((times[of_key] > 1) & (single[row] == 1))
        if not len(hit):
            return None
        cut = np.r_[True, (np.diff(hit) != 1) | (np.diff(row[hit]) != 0)]
        a, b = hit[cut], hit[np.r_[cut[1:], True]]
        return {"doc": doc[row[a]], "first": first[row[a]] + step[a], "last": first[row[b]] + step[b]}

    def each(t: pa.Table, group: np.ndarray):
        bytes_ = np.cumsum(t.column("size").to_numpy().astype(np.int64) + length - 1)
        a = 0
        while a < len(group):
            b = int(np.searchsorted(bytes_, (bytes_[a - 1] if a else 0) + CHUNK, side="right"))
            if b < len(group):  # whole groups only, one that is larger by itself
                b = int(np.searchsorted(group, group[b]))
                b = b if b > a else int(np.searchsorted(group, group[a], side="right"))
            found = part(t.slice(a, b - a), group[a:b])
            if found:
                yield found
            a = b

    return grouped_map(contexts, ["fp"], ["doc", "first"], each, "doc bigint, first bigint, last bigint", 2_000)


def _counted(contexts: DataFrame, ws: Workspace, length: int) -> DataFrame:
    """The same for groups of any size, by a row per string and counts."""

    def make():
        def each(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 1_000):
                t = pa.Table.from_batches([batch.slice(at, 1_000)])
                fp, far, size, doc, first = (
                    t.column(c).to_numpy().astype(np.int64) for c in ("fp", "far", "size", "doc", "first")
                )
                row, step, key = _hashes(t.column("raw").to_pylist(), size, length)
                yield {
                    "fp": fp[row], "k": far[row] - step, "key": key.view(np.int64),
                    "single": t.column("single").take(pa.array(row)), "doc": doc[row], "first": first[row] + step,
                }

        return each

    schema = "fp bigint, k int, key bigint, single boolean, doc bigint, first bigint"
    strings = ws.stored(arrow_map(contexts, make, schema), "strings")
    twice = strings.groupBy("fp", "k", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hits = strings.where("single").join(twice.select("fp", "k", "key"), ["fp", "k", "key"])
    return hits.select("doc", "first", F.col("first").alias("last"))


def repeated(docs: DataFrame, ws: Workspace, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``doc, runs``: of each document with repeats, the starts ``(first, last)`` of its repeated strings."""
    family = SuffixFamily(ws, length, seed)
    rows = _documents(docs).select("doc", "raw")
    for b in range(BATCHES):
        family.add(rows.where(F.pmod("doc", F.lit(BATCHES)) == b), last=b == BATCHES - 1)
    for _, name in family.levels:
        ws.delete(f"{family.folder}/{name}")
    return repeats_of(docs, family.found(), ws, length)


def repeats_of(docs: DataFrame, chosen: DataFrame, ws: Workspace, length: int = LENGTH) -> DataFrame:
    """The same from what a family found in these documents."""
    classes = chosen.groupBy("fp", "ext").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "place")).alias("one"))
    classes = ws.stored(classes, "classes")
    whole = chosen.join(classes.where("n > 1").select("fp", "ext"), ["fp", "ext"])
    runs = ws.stored(whole.selectExpr("doc", f"{FIRST} AS first", f"{LAST} AS last"), "whole-stretches")
    several = classes.groupBy("fp").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    members = classes.join(several, "fp").select("fp", "k", (F.col("n") == 1).alias("single"), "one.*")
    members = members.selectExpr(
        "fp", "k", "single", "doc", f"{FIRST} AS first", f"int({FAR}) AS far", f"int({LAST} - {FIRST} + 1) AS size"
    )
    contexts = _contexts(docs, members, ws, length)
    compared = _compared(contexts.where(F.col("k") <= GROUP).drop("k"), length)
    counted = _counted(contexts.where(F.col("k") > GROUP).drop("k"), ws, length)
    runs = runs.unionByName(compared).unionByName(counted)
    return runs.groupBy("doc").agg(F.collect_set(F.struct("first", "last")).alias("runs"))


def spans(first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that strings starting in ``first .. last`` cover."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], np.maximum.accumulate(last[order]) + length
    new = np.r_[True, a[1:] > b[:-1]]
    return a[new], b[np.r_[new[1:], True]]


def _whole_characters(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shrink runs so that no character is cut."""
    inside = np.r_[(text & 0xC0) == 0x80, False]
    a, b = a.copy(), b.copy()
    for _ in range(3):
        a += inside[a]
        b -= inside[b]
    return a[a < b], b[a < b]


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row."""
    with Workspace(docs.sparkSession) as ws:
        runs = ws.stored(repeated(docs, ws, length, seed), "runs").hint("merge")
        rows = _documents(docs).join(runs, "doc", "left").select("doc_id", "raw", "runs")

        def make():
            def each(batch: pa.RecordBatch):
                out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
                for raw, own in zip(batch.column(1), batch.column(2)):
                    data = raw.as_buffer()
                    a, b = _found(own, length)
                    out["n_bytes"].append(len(data))
                    out["n_removed"].append(int((b - a).sum()))
                    out["n_spans"].append(len(a))
                    out["kept_sha256"].append(hashlib.sha256(_left(data, a, b)).hexdigest())
                yield {"doc_id": batch.column(0)} | out

            return each

        schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
        with text_batches(docs.sparkSession):
            return ws.keep(arrow_map(rows, make, schema), "repeats-removed")


def without_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """The documents with what is left of their texts; all columns stay.

    Spans are shrunk to whole characters. ``n_chars`` follows the text. A
    document of which nothing is left goes.
    """
    with Workspace(docs.sparkSession) as ws:
        runs = ws.stored(repeated(docs, ws, length, seed), "runs").hint("merge")
        key, own = free_name(docs, "doc"), free_name(docs, "runs")
        runs = runs.withColumnsRenamed({"doc": key, "runs": own})
        rows = docs.withColumn(key, F.xxhash64(id_key(), text_key())).join(runs, key, "left")
        rows = rows.select(*docs.columns, own)
        given, text = list(docs.columns), docs.columns.index("text")

        def make():
            def each(batch: pa.RecordBatch):
                for begin, n in text_slices(batch.column(text), SLICE):
                    some = batch.slice(begin, n)
                    kept, stays = [], []
                    for was, own_ in zip(some.column(text), some.column(len(given))):
                        if not own_.is_valid:
                            kept.append(was.as_py())
                            stays.append(True)
                            continue
                        data = was.as_buffer()
                        a, b = _whole_characters(np.frombuffer(data, dtype=np.uint8), *_found(own_, length))
                        left = _left(data, a, b)
                        kept.append(left.decode())
                        stays.append(bool(left))
                    t = pa.Table.from_batches([some]).set_column(text, "text", pa.array(kept, pa.large_string()))
                    t = t.filter(pa.array(stays))
                    yield {c: t.column(i) for i, c in enumerate(given)}

            return each

        out = arrow_map(rows, make, docs.schema)
        if "n_chars" in docs.columns:
            n = F.when(F.col("n_chars").isNotNull(), F.length("text"))
            out = out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
        with text_batches(docs.sparkSession):
            return ws.keep(out, "without-repeats")


def _found(own: pa.Scalar, length: int) -> tuple[np.ndarray, np.ndarray]:
    if not own.is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return spans(*(own.values.field(i).to_numpy() for i in range(2)), length)


def _left(data, a: np.ndarray, b: np.ndarray) -> bytes:
    view = memoryview(data)
    return b"".join([view[i:j] for i, j in zip([0, *b], [*a, len(data)])])
