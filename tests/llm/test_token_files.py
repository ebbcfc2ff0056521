"""Token files: round trip, frames, checksums and single documents."""

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pairforge.llm import token_files
from pairforge.llm.common import Workspace

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def expected(texts):
    """Rows of the whole stream; rows of one id may come in either order."""
    library = Tokenizer.from_file(BYTES)
    return [
        (doc_id, np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4"))
        for doc_id, text in sorted(texts, key=lambda t: (t[0] is not None, t[0] or 0))
    ]


def check(rows, texts):
    wanted = expected(texts)
    found = sorted(rows, key=lambda r: r.start)
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
    key = lambda i: (i is not None, i or 0)
    assert [key(r.doc_id) for r in found] == [key(i) for i, _ in wanted]
    own = sorted((key(r.doc_id), r.n_tokens, r.ids_crc32) for r in found)
    assert own == sorted((key(i), len(x), zlib.crc32(x.tobytes())) for i, x in wanted)


def test_op11(query, docs):
    check(query(11).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_op11_odd_rows(odd, no_docs):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    check(token_files.round_trip(odd, BYTES).collect(), texts)
    assert token_files.round_trip(no_docs, BYTES).count() == 0


@pytest.fixture(scope="module")
def files(spark, docs):
    with Workspace(spark) as ws:
        folder = ws.path("token-files")
        yield token_files.write(docs, BYTES, folder, frame=4096), folder


def test_only_wanted_documents_are_decompressed(spark, docs, files):
    manifest, folder = files
    wanted = docs.where("doc_id % 50 = 0").select("doc_id")
    found = token_files.fetch(wanted, manifest, folder).collect()
    whole = {i: x for i, x in expected([(r.doc_id, r.text) for r in docs.collect()])}
    assert {r.doc_id for r in found} == {r.doc_id for r in wanted.collect()}
    for r in found:
        assert r.ids == whole[r.doc_id].tolist() and r.ids_crc32 == zlib.crc32(whole[r.doc_id].tobytes())
    everything = {r.doc_id: r.start for r in token_files.read(manifest, folder).collect()}
    assert all(r.start == everything[r.doc_id] for r in found)
    # One task reads one or two documents of a file: only their frames.
    n_frames = sum(r.n_frames for r in manifest.collect())
    one = token_files.fetch(docs.where("doc_id = 100").select("doc_id"), manifest, folder).collect()
    assert one[0].frames_read <= 2 + len(whole[100]) * 2 // 4096 < n_frames
    none = token_files.fetch(docs.where("doc_id = 100").selectExpr("doc_id + 10000000 AS doc_id"), manifest, folder)
    assert none.count() == 0


def raw_files(spark, files):
    manifest, folder = files
    binary = spark.read.format("binaryFile").load(f"{folder}/*.zst").collect()
    named = {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in binary}
    return [(r, named[r.file]) for r in manifest.orderBy("file_no").collect()]


def test_any_reader_sees_one_stream(spark, docs, files):
    whole = b"".join(token_files.whole_stream(raw) for _, raw in raw_files(spark, files))
    wanted = np.concatenate([x for _, x in expected([(r.doc_id, r.text) for r in docs.collect()])])
    assert np.frombuffer(whole, "<u2").tolist() == wanted.tolist()


def test_seek_table_has_the_public_layout(spark, files):
    for row, raw in raw_files(spark, files):
        assert raw[-4:] == (0x8F92EAB1).to_bytes(4, "little") and raw[-5] == 0x80
        n = int.from_bytes(raw[-9:-5], "little")
        table = len(raw) - 9 - 12 * n
        assert n == row.n_frames and len(raw) == row.n_bytes
        assert raw[table - 8 : table - 4] == (0x184D2A5E).to_bytes(4, "little")
        assert int.from_bytes(raw[table - 4 : table], "little") == 12 * n + 9


def test_a_damaged_frame_is_noticed(spark, files):
    row, raw = raw_files(spark, files)[0]
    entry = len(raw) - 9 - 12 * row.n_frames
    bad = raw[: entry + 8] + bytes([raw[entry + 8] ^ 1]) + raw[entry + 9 :]
    reader = token_files.FrameReader(io.BytesIO(bad), len(bad))
    with pytest.raises(ValueError, match="checksum"):
        reader.ids(0, int(reader.lengths[0]))
    with pytest.raises(ValueError, match="seek table"):
        token_files.FrameReader(io.BytesIO(raw[:-1]), len(raw) - 1)


def test_long_documents_and_unusual_ids():
    out = io.BytesIO()
    writer = token_files.FrameWriter(out, 2, frame=10)
    rows = [(None, []), (-(1 << 63), [7]), ((1 << 63) - 1, list(range(100))), (5, [1, 2]), (5, [])]
    for doc_id, ids in rows:
        writer.add(doc_id, np.array(ids, dtype="<u2").tobytes())
    writer.close()
    raw = out.getvalue()
    reader = token_files.FrameReader(io.BytesIO(raw), len(raw))
    assert [None if m else int(i) for i, m in zip(reader.doc_ids, reader.missing)] == [i for i, _ in rows]
    for at, n, (_, ids) in zip(reader.starts, reader.lengths, rows):
        assert reader.ids(int(at), int(n)).tolist() == ids
    assert reader.frames_read == len(writer.table) - 1
