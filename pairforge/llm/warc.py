"""WARC archives with a two-level capture index.

Writing: every page becomes one record, a gzip member of its own. Pages with
equal payloads of at least ``SHARED`` bytes are stored once, by the smallest
page id; the others are revisit records that refer to it. A task names its
files by its attempt and reports them in the captures table, which Spark
commits; files of a lost attempt are in no committed row and are never read.

Index: captures are sorted by reversed-host key and page id into compressed
blocks of lines (level one); a sparse directory holds the first key of each
block (level two). The lines of a block grow with the captures so that the
directory never exceeds ``DIRECTORY`` rows and one per partition; that bounds
what is sent to the tasks.

Reading: a wanted key is searched in the directory by bisection, then in the
lines of its block, and the record is fetched by a range read.

Cases: a null page is an empty payload; payloads under ``SHARED`` bytes are
always responses; a null url has the empty key; rows of one page id and equal
payload that repeat are all responses if that id is the smallest; a null id
refers to the smallest id of its payload, and is a response if there is none;
other columns are ignored; an empty table gives no files and no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairforge.llm.common import Workspace, arrow_map, arrow_schema, column, partitions, record, ship

SHARED = 100
#: A file is closed when it has this many bytes.
FILE_BYTES = 64 << 20
BLOCK_LINES = 1_000
DIRECTORY = 200_000
#: Neighbouring records are fetched together up to this many bytes.
READ_BYTES = 4 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str) -> Column:
    """Reversed host, then path and query: ``com,example)/a?b``."""
    u = F.coalesce(F.col(url), F.lit(""))
    parts = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)(?::[0-9]*)?([^#]*)"
    host = F.lower(F.regexp_extract(u, parts, 1))
    path = F.regexp_extract(u, parts, 2)
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    reverse = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.when(host == "", F.lower(u)).otherwise(F.concat(reverse, F.lit(")"), path))


def capture_key(url: str, page_id: str) -> Column:
    """Sort key of a capture: url key without white space, then the id in 20 digits."""
    place = F.col(page_id).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
    digits = F.coalesce(F.lpad(place.cast("string"), 20, "0"), F.lit("-"))
    clean = F.regexp_replace(url_key(url), r"[\s\x00-\x1f\x7f]", "%20")
    return F.concat(clean, F.lit(" "), digits)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _record(kind: str, name: str, url: str, digest: str, first: str | None, http: bytes) -> bytes:
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if first is not None:
        lines += [f"WARC-Refers-To: <{first}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http + b"\r\n\r\n"


def _name(page_id: int | None) -> str:
    return "urn:page:" + ("none" if page_id is None else str(page_id))


def write_archives(pages: DataFrame, folder: str, ws: Workspace) -> DataFrame:
    """Write the archives into ``folder``; returns the captures table.

    ``key, page_id, file, offset, length, record_type``.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        "page_id", "url", payload.alias("html"), capture_key("url", "page_id").alias("key"),
        F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).alias("n"),
    )
    shared = rows.where(F.col("n") >= SHARED).groupBy("digest")
    shared = shared.agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    shared = shared.where("copies > 1").select("digest", "first")
    # Payloads that occur twice; joined by shuffle if there are many of them.
    rows = rows.join(ws.small(shared, "shared-payloads"), "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.select("key", "page_id", "url", "digest", refers.alias("refers_to"), "html")

    def make():
        files, root = _open(folder)
        files.create_dir(root, recursive=True)
        attempt = uuid.uuid4().hex

        def each(batch: pa.RecordBatch):
            where: dict[str, list] = {"file": [], "offset": [], "length": [], "record_type": []}
            stream, name, at = None, "", 0
            for i in range(batch.num_rows):
                page_id, url, digest, first, html = (batch.column(c)[i].as_py() for c in range(1, 6))
                body = html.encode()
                kind = "response" if first is None else "revisit"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
                http = head.encode() + (body if first is None else b"")
                link = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
                refers = None if first is None else _name(first)
                raw = gzip.compress(_record(kind, _name(page_id), link, digest, refers, http), LEVEL, mtime=0)
                if stream is None or at >= FILE_BYTES:
                    if stream:
                        stream.close()
                    name, at = f"pages-{attempt}-{uuid.uuid4().hex[:8]}.warc.gz", 0
                    stream = files.open_output_stream(f"{root}/{name}", compression=None)
                stream.write(raw)
                for k, v in zip(where, (name, at, len(raw), kind)):
                    where[k].append(v)
                at += len(raw)
            stream.close()
            yield {"key": batch.column(0), "page_id": batch.column(1)} | where

        return each

    schema = "key string, page_id bigint, file string, offset bigint, length bigint, record_type string"
    return ws.stored(arrow_map(rows, make, schema), "captures")


def build_index(captures: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Blocks ``(block_id, first_key, data)`` in key order, and the directory of their first keys."""
    lines = max(BLOCK_LINES, -(-captures.count() // DIRECTORY))
    ordered = captures.repartitionByRange(partitions(captures.sparkSession), "key", "file", "offset")
    ordered = ordered.sortWithinPartitions("key", "file", "offset")

    kinds = arrow_schema("block_id bigint, first_key string, data binary")

    def block(number: int, part: pa.Table) -> pa.RecordBatch:
        rows = part.to_pylist()
        fields = ("page_id", "file", "offset", "length", "record_type")
        text = "".join(f"{r['key']} {json.dumps({k: r[k] for k in fields})}\n" for r in rows)
        columns = {"block_id": [number], "first_key": [rows[0]["key"]], "data": [zlib.compress(text.encode())]}
        return record(columns, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        waiting: list[pa.RecordBatch] = []
        n = 0
        # Rows are carried over batches, so only a partition's last block is short.
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n < lines:
                continue
            t = pa.Table.from_batches(waiting)
            whole = n - n % lines
            for at in range(0, whole, lines):
                yield block(number, t.slice(at, lines))
                number += 1
            waiting, n = t.slice(whole).to_batches(), n - whole
        if n:
            yield block(number, pa.Table.from_batches(waiting))

    ship(captures.sparkSession)
    blocks = ordered.mapInArrow(run, "block_id bigint, first_key string, data binary")
    blocks = ws.stored(blocks, "index-blocks")
    return blocks, blocks.select("block_id", "first_key")


def look_up(keys: DataFrame, blocks: DataFrame, directory: DataFrame) -> DataFrame:
    """Captures of the distinct ``keys`` (column ``key``): ``key, page_id, file, offset, length, record_type``."""
    spark = keys.sparkSession
    sparse = directory.orderBy("first_key", "block_id").toArrow()
    shared = spark.sparkContext.broadcast(
        (sparse.column("first_key").to_pylist(), sparse.column("block_id").to_numpy())
    )

    def make_search():
        firsts, ids = shared.value

        def each(batch: pa.RecordBatch):
            rows, found = [], []
            for row, key in enumerate(batch.column(0).to_pylist()):
                # Equal keys may begin in the block before.
                a, b = max(bisect_left(firsts, key) - 1, 0), bisect_right(firsts, key)
                found.extend(ids[a:b])
                rows += [row] * (b - a)
            yield {"key": batch.column(0).take(pa.array(rows, type=pa.int64())), "block_id": found}

        return each

    wanted = arrow_map(keys.select("key").distinct(), make_search, "key string, block_id bigint")
    # At most as many keys as the block has lines, and those between its borders.
    wanted = wanted.groupBy("block_id").agg(F.collect_list("key").alias("keys"))
    joined = blocks.join(wanted, "block_id").select("data", "keys")

    def make_block():
        def each(batch: pa.RecordBatch):
            for data, keys_ in zip(batch.column(0), batch.column(1)):
                lines = zlib.decompress(data.as_py()).decode().split("\n")[:-1]
                names = [x[: x.index(" {")] for x in lines]
                hits, of = [], []
                for key in keys_.as_py():
                    for i in range(bisect_left(names, key), bisect_right(names, key)):
                        hits.append(json.loads(lines[i][len(key) + 1 :]))
                        of.append(key)
                fields = ("page_id", "file", "offset", "length", "record_type")
                yield {"key": of} | {f: [h[f] for h in hits] for f in fields}

        return each

    schema = "key string, page_id bigint, file string, offset bigint, length bigint, record_type string"
    return arrow_map(joined, make_block, schema)


def parse(raw: bytes) -> dict:
    """Fields of one record, and its payload."""
    head, _, rest = gzip.decompress(raw).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["length"] = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"]
    return fields | {"payload": payload}


def read_records(captures: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Fetch records by range reads.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``; the
    first two of the stored payload, or for a revisit those it declares. With
    ``payloads`` also the payload; a revisit's is null.
    """
    near = captures.repartitionByRange(partitions(captures.sparkSession), "file", "offset")
    near = near.sortWithinPartitions("file", "offset").select("page_id", "file", "offset", "length")

    def make():
        files, root = _open(folder)

        def each(batch: pa.RecordBatch):
            names = batch.column(1).to_pylist()
            offset, length = column(batch, "offset"), column(batch, "length")
            new = np.ones(len(names), dtype=bool)
            same = np.array([a == b for a, b in zip(names[1:], names)], dtype=bool)
            new[1:] = ~same | (offset[1:] != offset[:-1] + length[:-1])
            out: dict[str, list] = {
                k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
            }
            a, n = 0, len(names)
            while a < n:
                b, size = a + 1, int(length[a])
                while b < n and not new[b] and size + length[b] <= READ_BYTES:
                    size += int(length[b])
                    b += 1
                with files.open_input_file(f"{root}/{names[a]}") as f:
                    raw = f.read_at(size, int(offset[a]))
                for i in range(a, b):
                    at = int(offset[i] - offset[a])
                    r = parse(raw[at : at + int(length[i])])
                    own = r["WARC-Type"] == "response"
                    digest = r["WARC-Payload-Digest"].removeprefix("sha256:")
                    page = r["WARC-Record-ID"][1:-1].removeprefix("urn:page:")
                    first = r.get("WARC-Refers-To", "")[1:-1].removeprefix("urn:page:")
                    out["page_id"].append(None if page == "none" else int(page))
                    out["payload_bytes"].append(len(r["payload"]) if own else int(r["length"]))
                    out["payload_digest"].append(hashlib.sha256(r["payload"]).hexdigest() if own else digest)
                    out["record_type"].append(r["WARC-Type"])
                    out["refers_to"].append(int(first) if first else None)
                    out["payload"].append(r["payload"] if own else None)
                a = b
            yield out

        return each

    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return arrow_map(near, make, schema + (", payload binary" if payloads else ""))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, index them, look every page up and read its record back."""
    with Workspace(pages.sparkSession) as ws:
        folder = ws.path("archives")
        captures = write_archives(pages, folder, ws)
        blocks, directory = build_index(captures, ws)
        keys = pages.select(capture_key("url", "page_id").alias("key"))
        return ws.keep(read_records(look_up(keys, blocks, directory), folder), "records")
