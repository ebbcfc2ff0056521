"""Boilerplate lines found by a log-template tree.

A line's tokens lead it down a tree of fixed depth: first the number of
tokens, then the leading tokens, where a token with a digit counts as a
variable field. A leaf gives two kinds of templates:

* the masked line itself, so lines that differ in numbers only share it;
* common forms: a line's tokens that are frequent at their position in the leaf
  are constant, the others are variable fields. Frequent is asked at several
  levels: ``MIN_DOCS`` lines, twice, four times as many and so on, and more than
  half of the leaf's remaining lines. So a leaf has a form for each group of
  similar lines, also if other lines outnumber it, and a template of n lines is
  one form as long as no word in its fields is in n/2 lines of the leaf at that
  place. A form counts if constant tokens make up ``CONSTANT`` of the line.

A template recurs if ``MIN_DOCS`` documents have it and its surroundings vary:
neither one line before it nor one line after it (by leaf) stands next to it in
more than ``SAME_PLACE`` of these documents on both sides. This is asked of the
lines next to it and, as a header or footer of several lines is one unit, of the
nearest own lines: those that are of no frequent template. It also recurs if
``MIN_DOCS`` different pairs of nearest own lines stand around it, however many
copies of one document have it too. Lines of copied documents keep their
neighbours, so copies do not make a line boilerplate; they are the work of the
near-duplicate stages. A document of whose lines less than ``OWN`` are its own
is taken for a copy, and its own lines (edits, mostly) say nothing of its
templates. Every line of a recurring template is dropped, the first one too.

Counts per line, leaf and position are summed before they are shuffled; a
document's lines meet as hashes, to find the own lines next to a template, and
the tokens of lines in frequent leaves meet their counts. Lines are split at
line feeds, tokens at white space; scripts that do not part words by spaces
give a token for each character.

Cases: null and empty texts have no lines and stay as they are; blank lines are
kept; a line of fewer than ``MIN_TOKENS`` tokens has no common form, and is a
template itself if it has a letter and ``SHORT_DOCS`` documents have it; a
document counts once for a template however often it has it; rows that repeat
count as documents of their own and get the same result; other columns stay.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairforge.llm.common import Workspace, arrow_map, free_name, id_key, text_batches, text_key, text_slices

MIN_DOCS = 8
SHORT_DOCS = 16
MIN_TOKENS = 3
LEADING = 2
CONSTANT = 0.6
SAME_PLACE = 0.5
OWN = 0.2
#: Bytes of text whose lines are looked at together, or one text.
TOGETHER = 1 << 20

DIGIT = re.compile(r"\d")
FIELD = "<*>"
#: Letters of Thai, Lao, Burmese, Khmer, kana and Han.
_UNSPACED = (
    "\u0e01-\u0e4e\u0e81-\u0ecf\u1000-\u103f\u1780-\u17d3\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
    "\uf900-\ufaff\U00020000-\U0003ffff"
)
UNSPACED = re.compile(f"[{_UNSPACED}]")
PIECE = re.compile(rf"[{_UNSPACED}]|[^{_UNSPACED}\s]+")


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode())
    return h - (1 << 64) if h >= 1 << 63 else h


def masked(line: str) -> list[str]:
    """Tokens of a line, those with a digit as a variable field."""
    tokens = line.split() if line.isascii() or not UNSPACED.search(line) else PIECE.findall(line)
    if DIGIT.search(line):
        tokens = [FIELD if DIGIT.search(t) else t for t in tokens]
    return tokens


def all_lines(text: str, leading: int) -> list[tuple[int, int, int, int, int, str, int, bool]]:
    """Of each line that is not blank: number, line, leaf, leaf before and after, tokens, how many, any letter."""
    found = []
    for i, line in enumerate(text.split("\n")):
        tokens = masked(line)
        if tokens:
            leaf = _hash("\x1f".join([str(len(tokens)), *tokens[:leading]]))
            found.append((i, " ".join(tokens), leaf, len(tokens)))
    leaves = [0, *[f[2] for f in found], 0]
    return [
        (i, _hash(line), leaf, leaves[k], leaves[k + 2], line, n, any(map(str.isalpha, line)))
        for k, (i, line, leaf, n) in enumerate(found)
    ]


def parsed(text: str, leading: int, min_tokens: int) -> list[tuple[int, int, int, int, int, str]]:
    """Of each line that can be a template: number, line, leaf, leaf before and after, tokens."""
    return [line[:6] for line in all_lines(text, leading) if line[6] >= min_tokens]


def _lines(docs: DataFrame, leading: int, with_text: bool) -> DataFrame:
    """One row per line of ``size`` tokens; ``first`` marks a line's first time in its document."""

    def make():
        def each(batch: pa.RecordBatch):
            for begin, n in text_slices(batch.column(2), TOGETHER):
                some = batch.slice(begin, n)
                rows, out = [], []
                for row, text in enumerate(some.column(2)):
                    seen = set()
                    for line in all_lines(text.as_py() or "", leading):
                        rows.append(row)
                        out.append((*line, line[1] not in seen))
                        seen.add(line[1])
                if rows:
                    at = pa.array(rows)
                    names = ("idx", "line", "leaf", "before", "after", "tokens", "size", "letter", "first")
                    columns = dict(zip(names, zip(*out)))
                    if not with_text:
                        del columns["tokens"]
                    yield {"id": some.column(0).take(at), "h": some.column(1).take(at)} | columns

        return each

    schema = "id bigint, h bigint, idx int, line bigint, leaf bigint, before bigint, after bigint, size int, letter boolean, first boolean"
    schema += ", tokens string" if with_text else ""
    return arrow_map(docs.select(id_key().alias("id"), text_key().alias("h"), "text"), make, schema)


def _once(found: DataFrame, key: str) -> DataFrame:
    """The first line of each key in each document."""
    sides = (F.min_by(side, "idx").alias(side) for side in ("before", "after"))
    return found.groupBy(key, "id", "h").agg(*sides)


def _recurring(once: DataFrame, key: str, min_docs: int, same_place: float) -> DataFrame:
    """Keys of rows, one per document, that recur in varying surroundings."""

    def top(side: str) -> DataFrame:
        n = once.groupBy(key, side).agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy(key).agg(F.sum("n").alias(f"docs_{side}"), F.max("n").alias(f"top_{side}"))

    both = top("before").join(top("after"), key)
    varied = F.least("top_before", "top_after") <= F.lit(same_place) * F.col("docs_before")
    return both.where((F.col("docs_before") >= min_docs) & varied).select(key)


def _apart(once: DataFrame, key: str, min_docs: int) -> DataFrame:
    """Keys of rows, one per document, that have enough different surroundings."""
    pairs = once.groupBy(key, "before", "after").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select(key)


def _outside(lines: DataFrame, marked: DataFrame) -> DataFrame:
    """``id, h, idx, before, after`` of the marked lines: the nearest own lines, by leaf.

    Only in documents with enough own lines; a document counts once however
    many rows have its id and text.
    """
    marked = marked.select("id", "h", "idx", F.lit(None).cast("bigint").alias("leaf"), F.lit(True).alias("marked"))
    rows = lines.select("id", "h", "idx", "leaf", F.lit(False).alias("marked")).unionByName(marked)
    rows = rows.groupBy("id", "h", "idx").agg(F.max("leaf").alias("leaf"), F.max("marked").alias("marked"))
    doc = Window.partitionBy("id", "h")
    up_to = (Window.unboundedPreceding, Window.currentRow)
    own = F.when(~F.col("marked"), F.col("leaf"))
    near = rows.select(
        "id", "h", "idx", "marked",
        F.coalesce(F.last(own, True).over(doc.orderBy("idx").rowsBetween(*up_to)), F.lit(0)).alias("before"),
        F.coalesce(F.last(own, True).over(doc.orderBy(F.desc("idx")).rowsBetween(*up_to)), F.lit(0)).alias("after"),
        F.avg(F.when(F.col("marked"), 0.0).otherwise(1.0)).over(doc).alias("own"),
    )
    return near.where(F.col("marked") & (F.col("own") >= OWN)).select("id", "h", "idx", "before", "after")


def boilerplate(
    docs: DataFrame,
    ws: Workspace,
    min_docs: int = MIN_DOCS,
    min_tokens: int = MIN_TOKENS,
    leading: int = LEADING,
    constant: float = CONSTANT,
    same_place: float = SAME_PLACE,
) -> DataFrame:
    """``id, h, lines``: numbers of the lines to drop in each document that has some."""
    every = ws.stored(_lines(docs, leading, False), "lines")
    lines = every.where(F.col("size") >= min_tokens)
    once = every.where("first").groupBy("line").agg(
        F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("letter").alias("letter")
    )
    long, short = F.col("size") >= min_tokens, F.col("letter") & (F.col("n") >= max(SHORT_DOCS, min_docs))
    often = once.where((F.col("n") >= min_docs) & (long | short)).select("line")
    often = every.join(ws.small(often, "frequent-lines"), "line")
    exact = ws.small(_recurring(often.where("first"), "line", min_docs, same_place), "line-templates")

    rest = lines.join(exact, "line", "left_anti")
    hot = rest.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    hot = ws.small(hot, "frequent-leaves", 1_000_000)
    texts = _lines(docs, leading, True).where(F.col("size") >= min_tokens)
    texts = texts.join(exact, "line", "left_anti").join(hot, "leaf")
    tokens = F.transform(F.split("tokens", " "), lambda t: F.xxhash64(t))
    texts = ws.stored(texts.drop("line", "letter", "first").withColumn("tokens", tokens), "leaf-lines")
    formed = ws.stored(_forms(texts, ws, min_docs, leading, constant), "formed-lines")
    frequent = _once(formed, "form").groupBy("form").count().where(F.col("count") >= min_docs).select("form")
    formed = formed.join(ws.small(frequent, "frequent-forms"), "form")

    marked = often.select("id", "h", "idx").unionByName(formed.select("id", "h", "idx"))
    outside = ws.stored(_outside(every, marked), "outside")

    def recurring(found: DataFrame, once: DataFrame, key: str) -> DataFrame:
        far = found.select(key, "id", "h", "idx").distinct().join(outside, ["id", "h", "idx"])
        far = ws.stored(_once(far, key), f"outside-{key}")
        both = _recurring(once, key, min_docs, same_place).union(_recurring(far, key, min_docs, same_place))
        return both.union(_apart(far, key, min_docs)).distinct()

    exact = ws.small(recurring(often, often.where("first"), "line"), "all-line-templates")
    forms = ws.small(recurring(formed, _once(formed, "form"), "form"), "form-templates")
    dropped = often.join(exact, "line").select("id", "h", "idx")
    dropped = dropped.unionByName(formed.join(forms, "form").select("id", "h", "idx"))
    return dropped.groupBy("id", "h").agg(F.collect_set("idx").alias("lines"))


def _forms(texts: DataFrame, ws: Workspace, min_docs: int, leading: int, constant: float) -> DataFrame:
    """``id, h, idx, form, before, after``: each line with the forms that it has."""
    own = ["id", "h", "idx", "leaf", "before", "after", "size"]
    tokens = texts.select(*own, "n", F.posexplode("tokens").alias("pos", "token"))
    counts = tokens.groupBy("leaf", "pos", "token").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"))
    level = F.floor(F.log2(F.col("k") / F.lit(min_docs)) + F.lit(1e-9)).cast("int")
    counts = counts.where(F.col("k") >= min_docs).select(
        "leaf", "pos", "token", level.alias("level"), (F.col("k") * 2 > F.col("n")).alias("most")
    )
    counts = ws.small(counts, "frequent-tokens", 300_000)
    enough = F.greatest(F.lit(constant) * F.col("size"), F.lit(leading))
    found = tokens.drop("n").join(counts, ["leaf", "pos", "token"]).groupBy(*own).agg(
        F.array_sort(F.collect_set(F.struct("pos", "token", "level", "most"))).alias("found")
    )
    found = found.where(F.size("found") >= enough)
    levels = F.transform(
        F.array_distinct(F.col("found.level")), lambda at: F.filter("found", lambda c: c["level"] >= at)
    )
    levels = F.concat(levels, F.array(F.filter("found", lambda c: c["most"])))
    levels = F.array_distinct(F.transform(levels, lambda form: F.transform(form, lambda c: F.struct(c["pos"], c["token"]))))
    formed = found.select(*own, F.explode(levels).alias("form")).where(F.size("form") >= enough)
    return formed.select("id", "h", "idx", F.xxhash64("leaf", "form").alias("form"), "before", "after")


def drop_lines(docs: DataFrame, **settings) -> DataFrame:
    """The documents without their boilerplate lines, and ``n_lines, n_dropped``.

    All columns stay; if they are there, ``text`` and ``n_chars`` are those of
    what is left. The two counts get other names if the table has theirs.
    """
    with Workspace(docs.sparkSession) as ws:
        with text_batches(docs.sparkSession):
            return ws.keep(_without(docs, ws, **settings), "lines-dropped")


def _without(docs: DataFrame, ws: Workspace, **settings) -> DataFrame:
    # As many rows as documents, so always by shuffle.
    marks = ws.stored(boilerplate(docs, ws, **settings), "dropped-lines").hint("merge")
    own, n_lines, n_dropped = (free_name(docs, n) for n in ("dropped", "n_lines", "n_dropped"))
    id_, h = free_name(docs, "id"), free_name(docs, "h")
    marks = marks.select(F.col("id").alias(id_), F.col("h").alias(h), F.col("lines").alias(own))
    joined = docs.withColumns({id_: id_key(), h: text_key()}).join(marks, [id_, h], "left")
    lines = F.split("text", "\n", -1)
    none = F.array().cast("array<int>")
    left = F.filter(lines, lambda _, i: ~F.array_contains(F.coalesce(F.col(own), none), i))
    text: Column = F.when(F.col(own).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    counts = {
        n_lines: F.when(F.length("text") > 0, F.size(lines)).otherwise(0),
        n_dropped: F.greatest(F.size(F.coalesce(F.col(own), none)), F.lit(0)),
    }
    out = joined.withColumns(counts).withColumn("text", text)
    if "n_chars" in docs.columns:
        n = F.when(F.col(n_dropped) > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns, n_lines, n_dropped)
