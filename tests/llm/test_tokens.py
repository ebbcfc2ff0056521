"""Encoding and packing against the library itself."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from pairforge.llm import bpe, packing

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = st.text(
    st.one_of(
        st.characters(max_codepoint=0x24F),
        st.sampled_from("'stremvld \n.,!Σςİﬀ½²日本́​ \x1c\x85\xa0"),
        st.characters(codec="utf-8"),
    ),
    max_size=40,
)
MARKED = st.one_of(TEXTS, st.tuples(TEXTS, TEXTS).map("<|endoftext|>".join))


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(WORDS), bpe.loaded(WORDS), Tokenizer.from_file(BYTES), packing.loaded(BYTES)


@settings(max_examples=400, deadline=None)
@given(text=MARKED)
def test_word_ids_and_decoding_equal_the_library(libraries, text):
    library, own, *_ = libraries
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(text=MARKED)
def test_byte_ids_equal_the_library(libraries, text):
    *_, library, own = libraries
    assert np.frombuffer(own.encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_stale_heap_entries_are_skipped():
    # ab first; then a|bc must not use the b that is gone
    rules = [(0, 1, 3), (1, 2, 4), (3, 2, 5)]
    ranks = {a << 32 | b: r for r, (a, b, _) in enumerate(rules)}
    assert bpe.merge_symbols([0, 1, 2], ranks, rules) == [5]
    assert bpe.merge_symbols([0, 0, 1, 1, 2], ranks, rules) == [0, 3, 4]


def check_words(rows, texts):
    library = Tokenizer.from_file(WORDS)
    wanted = []
    for doc_id, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        raw = np.array(ids, dtype="<u4").tobytes()
        wanted.append((str(doc_id), len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    found = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows]
    assert sorted(found) == sorted(wanted)


def test_op4(query, docs):
    check_words(query(4).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_op4_odd_rows(odd, no_docs):
    found = bpe.encode_decode(odd, WORDS, ids=True).collect()
    check_words(found, [(r.doc_id, r.text) for r in odd.collect()])
    assert all(len(r.ids) == r.n_tokens for r in found)
    assert bpe.encode_decode(no_docs, WORDS).count() == 0


def check_pieces(rows, texts, limit=1024):
    library = Tokenizer.from_file(BYTES)
    ids = {}
    for doc_id, text in texts:
        own = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        ids.setdefault((doc_id, len(own)), []).append(own)
    pieces = {}
    for r in rows:
        some = ids[r.doc_id, r.doc_tokens]
        cut = {zlib.crc32(x[r.start : r.start + r.length].tobytes()) for x in some}
        assert r.ids_crc32 in cut and r.length > 0
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    for key, some in ids.items():
        assert sum(n for _, n in pieces[key]) == key[1] * len(some)
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    at = 0
    for sequence, offset, n in places:
        assert (sequence, offset) == divmod(at, limit) and offset + n <= limit
        at += n


def test_op3(query, docs):
    check_pieces(query(3).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_op3_odd_rows_and_sequences(odd, no_docs):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    pieces = packing.pack(odd, BYTES, limit=64, ids=True)
    rows = pieces.collect()
    check_pieces(rows, texts, 64)
    made = packing.sequences(pieces, 64).collect()
    assert sum(r.n_tokens for r in made) == sum(r.length for r in rows)
    assert [r.n_tokens for r in sorted(made, key=lambda r: r.sequence_id)][:-1] == [64] * (len(made) - 1)
    assert all(len(r.ids) in (64, r.n_tokens) for r in made)
    assert packing.pack(no_docs, BYTES).count() == 0
