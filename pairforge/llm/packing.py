"""Packing by concatenation and cutting.

All documents form one stream of tokens, each document closed by one end id.
Pass one encodes every document once, where it is scanned, and writes its ids
with the number of its task and the tokens before it in that task. The totals
of the tasks, one row each, are summed in order; that gives every document its
place in the stream. Pass two cuts the documents at the borders of fixed
windows; each cut leaves two boundary records. Only the last sequence can be
short, so at most one sequence is padded.

Cases: a null text counts as empty; an empty text is the end id alone; rows
that repeat, also with the same id, are packed each for itself; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pairforge.llm.bpe import byte_letters
from pairforge.llm.common import Workspace, arrow_map, column, text_batches
from pairforge.operators.position import prefix_sums

LIMIT = 1024
END_ID = 0
#: Pieces of text that one worker remembers, each of at most so many
#: characters: together below 64 MB.
CACHE = 1 << 18
CACHED = 48


class PieceTokenizer:
    """Ids of whole texts as the tokenizers library gives them, faster.

    A text is cut before every space that follows something else than white
    space. The splitting pattern of the byte-level vocabulary never matches
    across such a place, so the pieces' ids joined are the text's ids. A piece
    that this worker has not met goes to the byte-pair library with the same
    vocabulary; as the ids of that file follow the order of its merges, both
    libraries give the same ids. A text with a special token, or with a run of
    white space, goes to the tokenizers library whole.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab(with_added_tokens=False)
        if len(vocab) > 1 << 16:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        marks = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.marks = re.compile("|".join(map(re.escape, marks)) or r"(?!)")
        letters = {s: b for b, s in byte_letters().items()}
        ranks = {bytes(letters[c] for c in s): i for s, i in vocab.items() if s not in marks}
        self.pairs = tiktoken.Encoding(
            "pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        self.known: dict[str, bytes] = {}
        self.stops = {c: self._new(c) for c in STOPS}

    def _whole(self, text: str) -> bytes:
        return array("H", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 16-bit ids."""
        if "  " in text or SPACE_BEFORE.search(text) or self.marks.search(text):
            return self._whole(text)
        known, other = self.known.get, self._piece
        first, *rest = text.split(" ")
        return self._new(first) + b"".join([known(p) or other(p) for p in rest])

    def _new(self, text: str) -> bytes:
        return array("H", self.pairs(text)).tobytes()

    def _piece(self, p: str) -> bytes:
        """A space and ``p``, which is not empty or not yet known as a whole."""
        if p[-1:] in STOPS and p[-2:-1].isalpha():
            return (self.known.get(p[:-1]) or self._piece(p[:-1])) + self.stops[p[-1]]
        word, _, line = p.partition("\n")
        if line and word and not word[-1].isspace() and not line[0].isspace():
            return (self.known.get(word) or self._piece(word)) + self._new("\n" + line)
        ids = self._new(" " + p)
        if len(p) <= CACHED:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[p] = ids
        return ids


#: Marks that are a piece of their own after a letter.
STOPS = (".", ",")
#: A space that another white space character precedes.
SPACE_BEFORE = re.compile(r"\s ")


@lru_cache(maxsize=2)
def loaded(path: str) -> PieceTokenizer:
    return PieceTokenizer(path)


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, ids, n, part, start``: ids with the end id, and their place in the task."""

    def make():
        tokens = loaded(vocabulary)
        end = np.uint16(END_ID).tobytes()
        part, total = TaskContext.get().partitionId(), 0

        def each(batch: pa.RecordBatch):
            nonlocal total
            ids = [tokens.encode(t.as_py() or "") + end for t in batch.column(1)]
            n = np.array([len(x) // 2 for x in ids], dtype=np.int64)
            starts = total + np.cumsum(n) - n
            total += int(n.sum())
            yield {
                "doc_id": batch.column(0), "ids": ids, "n": n,
                "part": np.full(len(n), part), "start": starts,
            }

        return each

    schema = "doc_id bigint, ids binary, n bigint, part bigint, start bigint"
    return arrow_map(docs.select("doc_id", "text"), make, schema)


def pack(docs: DataFrame, vocabulary: str, limit: int = LIMIT, ids: bool = False) -> DataFrame:
    """One row per piece of a document in a sequence.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and
    ``boundary``: whether the document goes on in the next sequence. With
    ``ids`` also the piece's ids, from which ``sequences`` builds the rows for
    training. The encoded table is written once and deleted afterwards.
    """
    spark = docs.sparkSession
    with Workspace(spark) as ws:
        with text_batches(spark):
            kept = ws.stored(encoded(docs, vocabulary), "encoded")
        totals = kept.groupBy("part").agg(F.sum("n").alias("total"))
        bases = prefix_sums(ws.stored(totals, "task-totals"), "part", {"base": F.col("total")})
        placed = kept.join(ws.small(bases.select("part", "base"), "task-bases"), "part").select(
            "doc_id", "ids", (F.col("base") + F.col("start")).alias("at")
        )
        return ws.keep(cut(placed, limit, ids), "packed")


def cut(placed: DataFrame, limit: int, with_ids: bool) -> DataFrame:
    """Cut documents ``doc_id, ids, at`` at the borders of the windows."""

    def make():
        def each(batch: pa.RecordBatch):
            doc_id, at = batch.column(0), column(batch, "at")
            out: dict[str, list] = {k: [] for k in ("row", "start", "end", "crc", "n", "raw")}
            for row, raw in enumerate(batch.column(1)):
                wide = np.frombuffer(raw.as_buffer(), dtype="<u2").astype("<u4")
                first = int(at[row])
                borders = [0, *range(limit - first % limit, len(wide), limit), len(wide)]
                view = memoryview(wide).cast("B")
                for a, b in zip(borders, borders[1:]):
                    out["row"].append(row)
                    out["start"].append(a)
                    out["end"].append(b)
                    out["crc"].append(zlib.crc32(view[4 * a : 4 * b]))
                    out["n"].append(len(wide))
                    if with_ids:
                        out["raw"].append(wide[a:b].astype(np.int32))
            row, start, end, n = (np.array(out[k], dtype=np.int64) for k in ("row", "start", "end", "n"))
            place = at[row] + start
            yield {
                "doc_id": doc_id.take(pa.array(row)), "start": start, "length": end - start,
                "ids_crc32": out["crc"], "doc_tokens": n, "sequence_id": place // limit,
                "offset": place % limit, "boundary": end < n,
            } | ({"ids": out["raw"]} if with_ids else {})

        return each

    schema = (
        "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "sequence_id bigint, offset bigint, boundary boolean"
    )
    return arrow_map(placed.select("doc_id", "ids", "at"), make, schema + (", ids array<int>" if with_ids else ""))


def sequences(pieces: DataFrame, limit: int = LIMIT, pad_id: int = END_ID) -> DataFrame:
    """``sequence_id, ids, doc_ids, n_tokens``: the rows for training.

    A sequence is padded to ``limit``, but not if its length is a power of
    two. A sequence has at most ``limit`` pieces, as none is empty.
    """
    rows = pieces.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p")
    )
    ids = F.flatten(F.col("p.ids"))
    n = F.size("ids")
    power = n.bitwiseAND(n - 1) == 0
    pad = F.when(power, 0).otherwise(limit - n)
    return (
        rows.select("sequence_id", ids.alias("ids"), F.col("p.doc_id").alias("doc_ids"))
        .withColumn("n_tokens", n)
        .withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad_id).cast("int"), pad)))
    )
