"""Archives read back through their index against the pages themselves."""

import gzip
import hashlib

from pairforge.llm import warc
from pairforge.llm.common import Workspace

SCHEMA = "page_id bigint, url string, html string, key string"


def wanted(rows):
    first = {}
    for page_id, html in rows:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    out = []
    for page_id, html in rows:
        raw = (html or "").encode()
        own = first.get(html or "")
        kind = "revisit" if len(raw) >= 100 and own is not None and own != page_id else "response"
        refers = own if kind == "revisit" else None
        out.append((str(page_id), len(raw), hashlib.sha256(raw).hexdigest(), kind, str(refers)))
    return sorted(out)


def as_rows(rows):
    return sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in rows)


def odd_pages():
    page = "<html>" + "é\r\n\r\nx" * 30 + "</html>"
    urls = ["http://a.example.com/x", "HTTPS://User@A.Example.com:80/x?q#f", "no url \r\n WARC-Type: x", "", None]
    rows = [(i, urls[i % 5], page if i % 3 else f"{page}{i}") for i in range(40)]
    rows += [(100, urls[0], None), (101, urls[0], ""), (102, urls[0], "short"), (103, urls[1], "short")]
    rows += [(1, urls[1], page), (1, urls[1], page), (None, urls[0], page), (None, None, "y" * 200), (104, "u", "z" * 300_000)]
    return [(*r, "k") for r in rows]


def test_op7(query, spark, sf):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert as_rows(query(7).collect()) == wanted(rows)


def test_odd_pages(spark, monkeypatch):
    rows = odd_pages()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert as_rows(warc.round_trip(df).collect()) == wanted([(r[0], r[2]) for r in rows])
    assert warc.round_trip(df.limit(0)).count() == 0


def test_index_and_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    monkeypatch.setattr(warc, "FILE_BYTES", 500)
    rows = odd_pages()
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    with Workspace(spark) as ws:
        folder = ws.path("archives")
        captures = warc.write_archives(df, folder, ws)
        assert captures.select("file").distinct().count() > 5
        blocks, directory = warc.build_index(captures, ws)
        assert blocks.count() > 8
        some = df.where("page_id in (3, 5, 104)").select(warc.capture_key("url", "page_id").alias("key"))
        hits = warc.look_up(some.union(some), blocks, directory)
        read = warc.read_records(hits, folder, payloads=True).collect()
        assert sorted(r.page_id for r in read) == [3, 5, 104]
        texts = {r[0]: r[2] for r in rows}
        assert all(r.payload is None or r.payload.decode() == texts[r.page_id] for r in read)
        missing = spark.createDataFrame([("com,none)/ 1",)], "key string")
        assert warc.look_up(missing, blocks, directory).count() == 0
        # A whole file is a valid series of gzip members.
        name = captures.first().file
        raw = spark.read.format("binaryFile").load(f"{folder}/{name}").first().content
        assert gzip.decompress(bytes(raw)).startswith(b"WARC/1.1\r\n")


def test_url_keys(spark):
    df = spark.createDataFrame([("http://www.Example.com:80/a?b#c",), ("https://x.org",), ("plain",), (None,)], "u string")
    keys = [r[0] for r in df.select(warc.url_key("u")).collect()]
    assert keys == ["com,example,www)/a?b", "org,x)/", "plain", ""]


def test_directory_is_bounded(spark, monkeypatch):
    """Blocks reach over Arrow batches: one short block for each partition at most."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 10)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        captures = spark.range(503).selectExpr(
            "concat('k', lpad(id, 4, '0')) AS key", "id AS page_id", "'f' AS file", "id AS offset", "1L AS length",
            "'response' AS record_type",
        )
        with Workspace(spark) as ws:
            blocks, directory = warc.build_index(captures, ws)
            parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
            assert directory.count() <= 503 // 10 + parts
            found = warc.look_up(captures.select("key"), blocks, directory)
            assert sorted((r.key, r.page_id) for r in found.collect()) == [(f"k{i:04}", i) for i in range(503)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
