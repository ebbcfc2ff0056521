"""Byte-pair encoding and decoding of whole texts with a given vocabulary.

A word's symbols form a doubly linked list. A heap holds the rank of every
neighbouring pair that can be merged; the best pair is merged, its new
neighbours are pushed, and entries whose symbols have changed meanwhile are
skipped when they come up. Equal ranks go from left to right. Decoding joins
the vocabulary's strings.

Plain Latin text is cut at white space, and each word is looked up in a table
of words this worker has met, emptied when it is full, so most words are
merged once. A text with any other character goes through the file's own
normaliser and splitter before the same merges.

Cases: a null text counts as empty; an empty text has no ids and decodes to an
empty text; repeated rows give repeated results; the strings of special tokens
inside a text become those tokens; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from pairforge.llm.common import arrow_map

#: Words that one worker remembers.
CACHE = 1_000_000
#: Characters whose case, class and normal form need no tables: Latin letters
#: without combining marks, and general punctuation. Four control characters
#: are white space to Python only.
PLAIN = re.compile("[\t-\r\x00-\x08\x0e-\x1b -ɏ‐-‧‰-⁞€]*")
SPACE = re.compile("[\t-\r \x85\xa0    ]+")


def byte_letters() -> dict[int, str]:
    """The visible letter that stands for each byte in byte-level vocabularies."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in visible}
    hidden = (b for b in range(256) if b not in letters)
    return letters | {b: chr(256 + i) for i, b in enumerate(hidden)}


def merge_symbols(
    ids: list[int], ranks: dict[int, int], rules: list[tuple[int, int, int]]
) -> list[int]:
    """Merge neighbouring symbols by rank until no pair has one.

    ``ranks`` has the rank of ``left << 32 | right``; ``rules`` by rank the two
    symbols and what they make. A heap entry is ``rank << 32 | position``.
    """
    n = len(ids)
    heap = []
    for i in range(n - 1):
        rank = ranks.get(ids[i] << 32 | ids[i + 1])
        if rank is not None:
            heap.append(rank << 32 | i)
    if not heap:
        return ids
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heapq.heapify(heap)
    while heap:
        entry = heapq.heappop(heap)
        i = entry & 0xFFFFFFFF
        left, right, made = rules[entry >> 32]
        j = after[i]
        if ids[i] != left or j >= n or ids[j] != right:
            continue  # stale: one of the two symbols has been merged since
        ids[i] = made
        ids[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = ranks.get(made << 32 | ids[k])
            if rank is not None:
                heapq.heappush(heap, rank << 32 | i)
        h = before[i]
        if h >= 0:
            rank = ranks.get(ids[h] << 32 | made)
            if rank is not None:
                heapq.heappush(heap, rank << 32 | h)
    return [x for x in ids if x >= 0]


class WordBpe:
    """Encoder and decoder for a file of words that end in a suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.end = model["end_of_word_suffix"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.ranks = {a << 32 | b: rank for rank, (a, b, _) in enumerate(self.rules)}
        letters = byte_letters()
        self.first = [vocab[letters[b]] for b in range(256)]
        self.last = [vocab[letters[b] + self.end] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        # The file's own pattern for plain Latin text, in terms of Python's classes.
        number = "0-9²³¹¼-¾"
        self.words = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d|[^\\W{number}_]+|[{number}]"
            f"|(?:[^\\w\\s]|_)+"
        )
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.known: dict[str, bytes] = {}

    def word(self, raw: bytes) -> bytes:
        """Little-endian ids of one word, given as bytes."""
        symbols = [self.first[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        return array("I", merge_symbols(symbols, self.ranks, self.rules)).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece[-1] in ".," and piece[-2:-1].isalpha():
            ids, stop = self.known.get(piece[:-1]), self.known.get(piece[-1])
            if ids and stop:  # a known word and a mark after it
                return ids + stop
        out = []
        for w in self.words.findall(piece):
            ids = self.known.get(w)
            if ids is None:
                if len(self.known) >= CACHE:
                    self.known.clear()
                ids = self.known[w] = self.word(w.encode())
            out.append(ids)
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        known, make = self.known.get, self._piece
        return b"".join([known(p) or make(p) for p in text.lower().split()])

    def _other(self, text: str) -> bytes:
        letters = {s: b for b, s in byte_letters().items()}
        split = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
        return b"".join([self.word(bytes(letters[c] for c in w)) for w, _ in split if w])

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if "<" not in text or not self.marks.search(text):
            return self._plain(text) if PLAIN.fullmatch(text) else self._other(text)
        out = []
        for part in self.marks.split(text):
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
            else:
                out.append(self._plain(part) if PLAIN.fullmatch(part) else self._other(part))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return array("I", self.encode_bytes(text)).tolist()

    def decode(self, ids) -> str:
        """The vocabulary's strings, with a space between, as the file has no decoder."""
        return " ".join([self.strings[i] for i in ids])


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    """One encoder for all tasks of a worker."""
    return WordBpe(path)


def encode_decode(docs: DataFrame, vocabulary: str, ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row.

    With ``ids`` also the ids themselves and the decoded text. No shuffle: the
    rows stay where they are scanned.
    """

    def make():
        bpe = loaded(vocabulary)

        def each(batch: pa.RecordBatch):
            out = {"doc_id": batch.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            out |= {"ids": [], "decoded": []} if ids else {}
            for text in batch.column(1):
                raw = bpe.encode_bytes(text.as_py() or "")
                decoded = bpe.decode(array("I", raw))
                out["n_tokens"].append(len(raw) // 4)
                out["ids_sha256"].append(hashlib.sha256(raw).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if ids:
                    out["ids"].append(array("I", raw).tolist())
                    out["decoded"].append(decoded)
            yield out

        return each

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<bigint>, decoded string" if ids else ""
    return arrow_map(docs.select("doc_id", "text"), make, schema)
