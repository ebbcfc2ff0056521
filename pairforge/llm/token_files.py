"""Token ids in files of independent zstandard frames with a seek table.

A file is a row of frames that can each be decompressed alone: frames of token
ids, one skippable frame with the document index, and as trailer the seek table
of the public seekable format, with the compressed size, the size and the
checksum (lower half of xxHash64) of every frame. Any zstandard program reads
the file from front to back as one stream of ids. A reader fetches the trailer
and the document index, then only the frames that hold the documents it wants,
and verifies each of them.

A frame has at most ``FRAME`` bytes of ids; a document begins a new frame unless
it fits into the current one, and only documents longer than a frame have
several. Ids are little-endian, of 16 or 32 bits by the vocabulary's size.

Writing: the texts move once, dealt out by ranges of the document id; each task
encodes its range in order and writes it into files, named after the attempt.
The manifest, one row per file, is committed by Spark, so the files of a lost
attempt are never read. A document's place among all ids is its place in its
file and the totals of the files before.

Cases: a null text counts as empty; an empty text is the end id alone; rows
without an id come first; rows of one id are ordered by a hash of their text,
equal rows as they are scanned; all rows are written; very long texts are cut
into frames; other columns are ignored; an empty table gives no files and no
rows. A frame with another checksum than the table's raises an error.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairforge.llm.common import Workspace, arrow_schema, column, id_key, partitions, record, ship
from pairforge.llm.packing import loaded
from pairforge.operators.position import prefix_sums

END_ID = 2
#: Bytes of ids in a frame.
FRAME = 128 << 10
#: A file is closed when its frames have this many bytes.
FILE_BYTES = 512 << 20
LEVEL = 3
#: Rows and bytes of ids that a reader gives out together.
BATCH_ROWS = 2_000
BATCH_BYTES = 4 << 20

# Fixed values of the public frame and seek table formats.
SKIPPABLE = 0x184D2A50
SEEK_TABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
WITH_CHECKSUMS = 0x80
#: Kind of the skippable frame that holds the document index.
DOCUMENTS = SKIPPABLE + 13

ENTRY = "<III"
FOOTER = "<IBI"
INDEX_HEAD = "<BQ"
MANIFEST = "file_no bigint, file string, n_docs bigint, n_tokens bigint, n_frames bigint, n_bytes bigint"


class FrameWriter:
    """Writes the documents' ids, given as bytes, to one stream."""

    def __init__(self, stream, width: int, frame: int = FRAME, level: int = LEVEL):
        import xxhash
        import zstandard

        self.stream, self.width = stream, width
        self.frame = frame - frame % width
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.digest = xxhash.xxh64_intdigest
        self.waiting: list[bytes] = []
        self.held = 0
        self.table: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.n_bytes = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // self.width)
        if self.held + len(ids) > self.frame:
            self._flush()
        for at in range(0, len(ids), self.frame):
            part = ids[at : at + self.frame]
            self.waiting.append(part)
            self.held += len(part)
            if self.held >= self.frame:
                self._flush()

    def _flush(self) -> None:
        if self.held:
            raw = b"".join(self.waiting)
            packed = self.compress(raw)
            self._write(packed, len(raw), self.digest(raw) & 0xFFFFFFFF)
            self.waiting, self.held = [], 0

    def _write(self, frame: bytes, size: int, checksum: int) -> None:
        self.stream.write(frame)
        self.table.append((len(frame), size, checksum))
        self.n_bytes += len(frame)

    def close(self) -> None:
        """Document index and seek table; the stream is left open."""
        self._flush()
        missing = np.array([i is None for i in self.doc_ids], dtype=np.uint8)
        ids = np.array([i or 0 for i in self.doc_ids], dtype="<i8")
        index = struct.pack(INDEX_HEAD, self.width, len(ids)) + missing.tobytes()
        # Neighbouring ids are close, so their differences compress well.
        with np.errstate(over="ignore"):
            index += np.diff(ids, prepend=np.int64(0)).astype("<i8").tobytes()
        index = self.compress(index + np.array(self.lengths, dtype="<u8").tobytes())
        self._write(struct.pack("<II", DOCUMENTS, len(index)) + index, 0, 0)
        table = b"".join(struct.pack(ENTRY, *e) for e in self.table)
        table += struct.pack(FOOTER, len(self.table), WITH_CHECKSUMS, SEEKABLE)
        table = struct.pack("<II", SEEK_TABLE, len(table)) + table
        self.stream.write(table)
        self.n_bytes += len(table)


class FrameReader:
    """Range reads from one file; ``frames_read`` counts decompressed frames."""

    def __init__(self, file, size: int):
        import xxhash
        import zstandard

        self.file, self.digest = file, xxhash.xxh64_intdigest
        self.decompress = zstandard.ZstdDecompressor().decompress
        self.frames_read = 0
        self.last: tuple[int, bytes] = (-1, b"")
        tail, entry, head = (struct.calcsize(f) for f in (FOOTER, ENTRY, INDEX_HEAD))
        n, kind, magic = struct.unpack(FOOTER, self._at(size - tail, tail))
        if magic != SEEKABLE or kind != WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        raw = self._at(size - tail - n * entry, n * entry)
        table = np.frombuffer(raw, dtype="<u4").reshape(n, 3).astype(np.int64)
        self.packed, self.sizes, self.checksums = table.T
        self.places = np.cumsum(self.packed) - self.packed
        #: First byte of each frame in the stream of ids, and the end of the last.
        self.borders = np.r_[0, np.cumsum(self.sizes)]
        where = int(self.places[-1])
        kind, length = struct.unpack("<II", self._at(where, 8))
        if kind != DOCUMENTS:
            raise ValueError("the last frame is no document index")
        index = self.decompress(self._at(where + 8, length))
        self.width, n_docs = struct.unpack_from(INDEX_HEAD, index)
        at = head
        self.missing = np.frombuffer(index, np.uint8, n_docs, at).astype(bool)
        with np.errstate(over="ignore"):
            self.doc_ids = np.cumsum(np.frombuffer(index, "<i8", n_docs, at + n_docs))
        self.lengths = np.frombuffer(index, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(int(offset))
        return self.file.read(int(size))

    def _frame(self, k: int) -> bytes:
        if self.last[0] != k:
            raw = self.decompress(self._at(self.places[k], self.packed[k]), max_output_size=int(self.sizes[k]))
            self.frames_read += 1
            if len(raw) != self.sizes[k] or self.digest(raw) & 0xFFFFFFFF != self.checksums[k]:
                raise ValueError(f"frame {k} does not match its checksum")
            self.last = (k, raw)
        return self.last[1]

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start`` of the file as unsigned 32-bit numbers."""
        a, b = start * self.width, (start + n) * self.width
        k = int(np.searchsorted(self.borders, a, side="right")) - 1
        parts = []
        while a < b:
            end = min(b, int(self.borders[k + 1]))
            parts.append(self._frame(k)[a - int(self.borders[k]) : end - int(self.borders[k])])
            a, k = end, k + 1
        return np.frombuffer(b"".join(parts), dtype=f"<u{self.width}").astype("<u4")


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, vocabulary: str, folder: str, end_id: int = END_ID, frame: int = FRAME) -> DataFrame:
    """Encode all documents into files in ``folder``; returns the manifest.

    ``file_no`` ascends with the document ids. The manifest is a table in the
    same folder.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text",
        F.xxhash64("text").alias("key"), F.monotonically_increasing_id().alias("row"),
    )
    order = ["doc_id", "key", "row"]  # null ids first; the row splits a hot id
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    kinds = arrow_schema(MANIFEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, (files, root) = loaded(vocabulary), _open(folder)
        width = 2  # this tokenizer takes vocabularies of 16 bits
        end = end_id.to_bytes(width, "little")
        part, attempt, made = TaskContext.get().partitionId(), uuid.uuid4().hex, []
        out, stream = None, None

        def close() -> None:
            out.close()
            stream.close()
            made.append((out.doc_ids, sum(out.lengths), len(out.table), out.n_bytes))

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                if out is not None and out.n_bytes >= FILE_BYTES:
                    close()
                    out = None
                if out is None:
                    stream = files.open_output_stream(f"{root}/ids-{attempt}-{len(made)}.zst", compression=None)
                    out = FrameWriter(stream, width, frame)
                out.add(doc_id.as_py(), tokens.encode(text.as_py() or "") + end)
        if out is not None:
            close()
        if made:
            yield record(
                {
                    "file_no": [(part << 20) + i for i in range(len(made))],
                    "file": [f"ids-{attempt}-{i}.zst" for i in range(len(made))],
                    "n_docs": [len(m[0]) for m in made], "n_tokens": [m[1] for m in made],
                    "n_frames": [m[2] for m in made], "n_bytes": [m[3] for m in made],
                },
                kinds,
            )

    ship(spark)
    files, root = _open(folder)
    files.create_dir(root, recursive=True)
    dealt.select("doc_id", "text").mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _placed(files: DataFrame) -> DataFrame:
    """The files with ``base``, the ids of all files before."""
    return prefix_sums(files.select("file_no", "file", "n_tokens", "n_bytes"), "file_no", {"base": F.col("n_tokens")})


FOUND = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def _batches(docs: Iterable[tuple], with_ids: bool, kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Records of ``(doc_id, start, ids)``, cut by rows and bytes."""
    out: dict[str, list] = {}
    held = 0

    def flush() -> pa.RecordBatch:
        return record(out, kinds)

    for doc_id, start, ids in docs:
        if not out:
            out, held = {name: [] for name in kinds.names}, 0
        out["doc_id"].append(doc_id)
        out["start"].append(start)
        out["n_tokens"].append(len(ids))
        out["ids_crc32"].append(zlib.crc32(ids))
        if with_ids:
            out["ids"].append(ids.astype(np.int32))
        held += ids.nbytes
        if len(out["doc_id"]) >= BATCH_ROWS or held >= BATCH_BYTES:
            yield flush()
            out = {}
    if out:
        yield flush()


def read(files: DataFrame, folder: str, ids: bool = False) -> DataFrame:
    """Every document of the files: ``doc_id, start, n_tokens, ids_crc32``, and ``ids``.

    One task reads a file frame by frame; only the current frame, the file's
    index and the documents of one batch are in memory.
    """
    schema = FOUND + (", ids array<int>" if ids else "")
    kinds = arrow_schema(schema)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        there, root = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with there.open_input_file(f"{root}/{row['file']}") as f:
                    r = FrameReader(f, row["n_bytes"])
                    for doc_id, null, at, n in zip(r.doc_ids, r.missing, r.starts, r.lengths):
                        yield None if null else int(doc_id), row["base"] + int(at), r.ids(int(at), int(n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(documents(batches), ids, kinds)

    ship(files.sparkSession)
    placed = _placed(files).repartitionByRange(partitions(files.sparkSession), "file_no")
    return placed.select("file", "n_bytes", "base").mapInArrow(run, schema)


def index(files: DataFrame, folder: str) -> DataFrame:
    """``doc_id, file_no, file, n_bytes, base, at, n``: the documents' places, from the indexes alone."""
    schema = "doc_id bigint, file_no bigint, file string, n_bytes bigint, base bigint, at bigint, n bigint"
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, root = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with there.open_input_file(f"{root}/{row['file']}") as f:
                    r = FrameReader(f, row["n_bytes"])
                n = len(r.doc_ids)
                same = {k: pa.repeat(pa.scalar(row[k], kinds.field(k).type), n) for k in ("file_no", "file", "n_bytes", "base")}
                yield record({"doc_id": pa.array(r.doc_ids, mask=r.missing), "at": r.starts, "n": r.lengths} | same, kinds)

    ship(files.sparkSession)
    placed = _placed(files).repartitionByRange(partitions(files.sparkSession), "file_no")
    return placed.select("file_no", "file", "n_bytes", "base").mapInArrow(run, schema)


def fetch(wanted: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """The documents whose ``doc_id`` is in ``wanted``, decompressing only their frames.

    ``doc_id, start, n_tokens, ids_crc32, ids, frames_read``; the last is how
    many frames the task had decompressed of the file so far. Wanted documents
    are dealt out in ranges of files and places, so a file that many documents
    are wanted of is read by several tasks.
    """
    schema = FOUND + ", ids array<int>, frames_read bigint"
    kinds = arrow_schema(schema)
    keys = wanted.select(id_key().alias("_key")).distinct()
    found = index(files, folder).withColumn("_key", id_key()).join(keys, "_key", "left_semi").drop("_key")
    found = found.repartitionByRange(partitions(files.sparkSession), "file_no", "at")
    found = found.sortWithinPartitions("file_no", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, root = _open(folder)
        name, stream, reader = None, None, None
        for batch in batches:
            files_, sizes, n = batch.column(2).to_pylist(), column(batch, "n_bytes"), column(batch, "n")
            base, at = column(batch, "base"), column(batch, "at")
            for i, doc_id in enumerate(batch.column(0)):
                if files_[i] != name:
                    if stream is not None:
                        stream.close()
                    name = files_[i]
                    stream = there.open_input_file(f"{root}/{name}")
                    reader = FrameReader(stream, int(sizes[i]))
                ids = reader.ids(int(at[i]), int(n[i]))
                yield record(
                    {
                        "doc_id": [doc_id.as_py()], "start": [int(base[i] + at[i])], "n_tokens": [len(ids)],
                        "ids_crc32": [zlib.crc32(ids)], "ids": [ids.astype(np.int32)],
                        "frames_read": [reader.frames_read],
                    },
                    kinds,
                )
        if stream is not None:
            stream.close()

    ship(files.sparkSession)
    return found.mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write all documents, read every file back: ``doc_id, start, n_tokens, ids_crc32``."""
    with Workspace(docs.sparkSession) as ws:
        folder = ws.path("token-files")
        return ws.keep(read(write(docs, vocabulary, folder), folder), "read-back")


def whole_stream(raw: bytes) -> bytes:
    """The ids of a file as any zstandard reader sees them."""
    import zstandard

    reader = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True)
    return reader.read()
