"""Language of every text, and its spans, by script ranges and Viterbi search.

A language's model is a table of fixed size: how often each of ``BUCKETS``
hashed character n-grams occurs in its words, and how many of its letters lie
in each script range. Both are counted over all learning documents, summed in
each task first.

A word's script leaves as candidates the languages that use it. Its score for
a candidate is the sum of the log-probabilities of its n-grams. Over the words
of a text, Viterbi search finds the best sequence of languages when each change
costs ``SWITCH``; that labels the spans of mixed texts. The text's language is
the one with most letters, its score their share.

Words are the pieces between white space in lower case. Each distinct word of
a slice is scored once; the search steps through the texts of several slices at
once.

Cases: a null text, or one without a letter, is ``und`` with score 0; words
without a letter take the language around them; ties go to the language first
in alphabetical order; a null ``lang`` is not learned; without any learned
language every text is ``und``; rows that repeat get the same result; texts are searched
whole, in slices bounded by bytes, and a very long one alone; an empty table
gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pairforge.llm.common import arrow_map, held_out, mix, text_slices, with_fields

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
SWITCH = 12.0
#: Added to every count.
SMOOTH = 0.1
#: A language uses a script if this share of its letters lies in it.
SCRIPT_SHARE = 0.001
#: Score of a language that does not use a word's script.
FOREIGN = -1000.0
#: Texts whose words are scored together: at most so many bytes, or one text.
#: Their n-grams take some sixty times as much memory.
TOGETHER = 512 << 10
#: Texts that are searched together; what is left of them then are the scores.
SEARCHED = 4 << 20

#: First and last code points of script ranges (fixed values, from Unicode).
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
NAMES = [*dict.fromkeys(s[0] for s in SCRIPTS), "other"]


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Script number of each code point that is a letter, -1 for the others."""
    table = np.full(0x110000, -1, dtype=np.int8)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = len(NAMES) - 1
    for name, first, last in SCRIPTS:
        part = table[first : last + 1]
        part[part >= 0] = NAMES.index(name)
    return table


class Words:
    """Words of a batch of texts: number of each word, and the distinct ones."""

    def __init__(self, texts: pa.Array):
        lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        split = pc.utf8_split_whitespace(lower)
        self.sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        words = split.flatten().dictionary_encode()
        self.codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        distinct = words.dictionary.to_pylist()
        marked = "".join([f" {w} " for w in distinct])
        points = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.fromiter(map(len, distinct), np.int64, len(distinct)) + 2
        self.starts = np.cumsum(lengths) - lengths
        of_word = np.repeat(np.arange(len(distinct)), lengths)
        script = letters()[points]
        self.letters = np.zeros(len(distinct), dtype=np.int64)
        self.script = np.full(len(distinct), -1, dtype=np.int64)
        if len(distinct):
            self.letters = np.add.reduceat((script >= 0).astype(np.int64), self.starts)
            self.script = np.maximum.reduceat(script, self.starts).astype(np.int64)
        grams, owners = [], []  # of 32 bits: they are the bulk of what a slice holds
        key = np.zeros(len(points), dtype=np.uint64)
        for order in range(1, max(ORDERS) + 1):
            n = len(points) - order + 1
            if n <= 0:
                break
            key = mix(key[:n] ^ mix(points[order - 1 :].astype(np.uint64) + np.uint64(order)))
            if order in ORDERS:
                inside = of_word[:n] == of_word[order - 1 :]
                grams.append((key[inside] % np.uint64(BUCKETS)).astype(np.int32))
                owners.append(of_word[:n][inside].astype(np.int32))
        self.grams = np.concatenate(grams) if grams else np.zeros(0, np.int32)
        self.owners = np.concatenate(owners) if owners else np.zeros(0, np.int32)


def learn(docs: DataFrame) -> "Model":
    """Count the n-grams and scripts of all documents that may be learned from.

    The counts are ``BUCKETS`` and a few numbers per language, whatever the
    input, and come to the driver in that form.
    """

    def make():
        def each(batch: pa.RecordBatch):
            langs = batch.column(0).dictionary_encode()
            codes = langs.indices.to_numpy(zero_copy_only=False)
            size = BUCKETS + len(NAMES)
            total = np.zeros((len(langs.dictionary), size), dtype=np.int64)
            for at, n in text_slices(batch.column(1), TOGETHER):
                w = Words(batch.column(1).slice(at, n))
                of_text = np.repeat(codes[at : at + n], w.sizes)
                for k in np.unique(of_text):
                    times = np.bincount(w.codes[of_text == k], minlength=len(w.script))
                    total[k, :BUCKETS] += np.bincount(
                        w.grams, weights=(times * (w.letters > 0))[w.owners], minlength=BUCKETS
                    ).astype(np.int64)
                    known = w.script >= 0
                    total[k, BUCKETS:] += np.bincount(
                        w.script[known], weights=(times * w.letters)[known], minlength=len(NAMES)
                    ).astype(np.int64)
            k, bucket = np.nonzero(total)
            yield {
                "lang": langs.dictionary.take(pa.array(k)),
                "bucket": bucket, "n": total[k, bucket],
            }

        return each

    learned = docs.where(F.col("lang").isNotNull() & ~held_out()).select("lang", "text")
    counts = arrow_map(learned, make, "lang string, bucket int, n bigint")
    rows = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    return Model(rows)


class Model:
    """Log-probabilities of the n-grams and scripts in use, by language."""

    def __init__(self, rows: pa.Table):
        found = rows.column("lang").combine_chunks().dictionary_encode()
        names = found.dictionary.to_pylist()
        self.langs = sorted(names)
        place = np.array([self.langs.index(x) for x in names], dtype=np.int64)
        counts = np.zeros((len(names), BUCKETS + len(NAMES)))
        if names:
            lang = place[found.indices.to_numpy(zero_copy_only=False)]
            counts[lang, rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
        grams = counts[:, :BUCKETS] + SMOOTH
        self.grams = np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32)
        scripts = counts[:, BUCKETS:]
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.uses = (share >= SCRIPT_SHARE).T

    def scores(self, w: Words) -> np.ndarray:
        """Score of each distinct word for each language; 0 for words without letters."""
        out = np.empty((len(w.script), len(self.langs)))
        if not self.langs:
            return out
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(w.owners, weights=self.grams[w.grams, k], minlength=len(w.script))
        uses = self.uses[w.script]
        out += np.where(uses | ~uses.any(axis=1, keepdims=True), 0.0, FOREIGN)
        out -= out.max(axis=1, keepdims=True)
        out[w.letters == 0] = 0.0
        return out


def viterbi(scores: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """Best language of each word; ``scores`` has the words of one text after the other."""
    n, k = scores.shape
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    active = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")
    came = np.zeros((n, k), dtype=np.int16)
    best = np.zeros((len(sizes), k))
    stay = np.arange(k, dtype=np.int16)
    for step, m in enumerate(active):
        at = starts[:m] + step
        now = best[:m]
        if step:
            top = now.argmax(axis=1)
            moved = now[np.arange(m), top] - switch
            change = now < moved[:, None]
            came[at] = np.where(change, top[:, None], stay)
            now = np.maximum(now, moved[:, None])
        best[:m] = now + scores[at]
    labels = np.zeros(n, dtype=np.int64)
    state = best.argmax(axis=1) if len(sizes) else np.zeros(0, np.int64)
    for step in range(len(active) - 1, -1, -1):
        m = active[step]
        at = starts[:m] + step
        labels[at] = state[:m]
        state[:m] = came[at, state[:m]]
    return labels


def with_language(
    docs: DataFrame, model: Model, pred: str = "lang_pred", score: str = "score",
    spans: str | None = None, switch: float = SWITCH,
) -> DataFrame:
    """All columns of ``docs``, the language and its score under new names.

    With ``spans`` also an array of ``(lang, first_word, n_words)``. Each row
    stays where it is scanned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")
    given = [f.name for f in docs.schema.fields]

    def make():
        m: Model = shared.value
        names = np.array([*m.langs, "und"], dtype=object)

        def each(batch: pa.RecordBatch):
            for at, n in text_slices(batch.column(text), SEARCHED):
                some = batch.slice(at, n)
                parts = []
                for begin, length in text_slices(some.column(text), TOGETHER):
                    w = Words(some.column(text).slice(begin, length))
                    parts.append((w.sizes, w.letters[w.codes], m.scores(w)[w.codes]))
                sizes, letters_, scores = (np.concatenate(x) for x in zip(*parts))
                of_text = np.repeat(np.arange(n), sizes)
                total = np.bincount(of_text, weights=letters_, minlength=n)
                labels = np.zeros(len(letters_), dtype=np.int64)
                share = np.zeros((n, max(1, len(m.langs))))
                if m.langs:
                    labels = viterbi(scores, sizes, switch)
                    np.add.at(share, (of_text, labels), letters_)
                share /= np.maximum(total, 1)[:, None]
                known = (total > 0) & bool(m.langs)
                best = np.where(known, share.argmax(axis=1), len(m.langs))
                out = {c: some.column(i) for i, c in enumerate(given)}
                out |= {pred: list(names[best]), score: np.where(known, share.max(axis=1), 0.0)}
                if spans:
                    out[spans] = _spans(labels, sizes, names, known)
                yield out

        return each

    extra = f"`{pred}` string, `{score}` double"
    extra += f", `{spans}` array<struct<lang:string,first_word:int,n_words:int>>" if spans else ""
    return arrow_map(docs, make, with_fields(docs.schema, extra))


def identify(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, and ``spans`` if they are asked for."""
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return with_language(rows, model, spans="spans" if spans else None).drop("text")


def _spans(labels: np.ndarray, sizes: np.ndarray, names: np.ndarray, known: np.ndarray) -> list[list[dict]]:
    out, at = [], 0
    for size, there in zip(sizes, known):
        own = labels[at : at + size]
        at += size
        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1), size] if size and there else [0]
        out.append(
            [
                {"lang": names[own[a]], "first_word": int(a), "n_words": int(b - a)}
                for a, b in zip(cuts, cuts[1:])
            ]
        )
    return out
