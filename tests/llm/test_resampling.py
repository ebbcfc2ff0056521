"""Resampling against counted strings."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from pairforge.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def runs_of(text):
    words = WORD.findall((text or "").translate(UPPER))
    return [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)], len(words)


def bucket(run):
    return zlib.crc32(run.encode("utf-8", "surrogatepass")) % 10_000


def plain(docs, target, percent=5):
    source, wanted = Counter(), Counter()
    runs = [(i, *runs_of(t)) for i, t in docs]
    for _, own, _ in runs:
        source.update(map(bucket, own))
    for t in target:
        wanted.update(map(bucket, runs_of(t)[0]))
    s_all, t_all = sum(source.values()), sum(wanted.values())

    def gain(b):
        return math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10_000) / ((source[b] + 1) * (t_all + 10_000))))

    rows, long = [], []
    for i, own, n_words in runs:
        weight = sum(gain(bucket(r)) for r in own)
        mixed = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
        h = int(mixed[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n_words >= 20:
            long.append(rows[-1])
    long.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for rank, r in enumerate(long[: percent * len(long) // 100], 1):
        r[4] = rank
    return sorted(map(repr, rows))


def rows(df):
    return sorted(repr([r.doc_id, r.n_features, r.weight, r.score, r["rank"]]) for r in df.collect())


def test_op13(spark, sf, query, docs):
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = query(13)
    assert [t for _, t in found.dtypes] == ["bigint"] * 5
    assert rows(found) == plain([(r.doc_id, r.text) for r in docs.collect()], target)


def test_odd_rows(spark, odd, no_docs):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    target = spark.createDataFrame([(1, None), (2, ""), (3, "The cat sat"), (4, "the CAT sat on")], "item_id int, text string")
    for percent in (5, 60, 100):
        found = resampling.resample(odd, target, percent=percent)
        assert rows(found) == plain(texts, [r.text for r in target.collect()], percent)
    assert rows(resampling.resample(odd, target.limit(0))) == plain(texts, [])
    assert resampling.resample(no_docs, target).count() == 0
    drawn = resampling.drawn_documents(odd, resampling.resample(odd, target, percent=60))
    assert drawn.columns == odd.columns and 0 < drawn.count() <= len(texts)


TEXTS = st.lists(
    st.one_of(st.none(), st.text(st.one_of(st.sampled_from("ab Z9é\n/:`{日\x80"), st.characters(codec="utf-8")), max_size=60)),
    max_size=6,
)


@settings(max_examples=300, deadline=None)
@given(texts=TEXTS)
def test_runs_equal_those_of_strings(texts):
    found = resampling.Runs(pa.array(texts, type=pa.string()))
    at = 0
    for text, n_words, n_runs in zip(texts, found.n_words, found.n_runs):
        own, n = runs_of(text)
        assert (n_words, n_runs) == (n, len(own))
        assert found.buckets[at : at + n_runs].tolist() == [bucket(r) for r in own]
        at += n_runs


@settings(max_examples=200, deadline=None)
@given(a=st.binary(max_size=50), b=st.binary(max_size=3000))
def test_crc_of_the_later_part(a, b):
    whole = zlib.crc32(a + b)
    shifted = resampling.shifted(np.array([zlib.crc32(a)], dtype=np.uint32), np.array([len(b)]))
    assert int(whole ^ int(shifted[0])) == zlib.crc32(b)


def test_very_long_shifts():
    n = (1 << 24) + 12_345
    whole = zlib.crc32(b"start" + b"x" * n)
    shifted = resampling.shifted(np.array([zlib.crc32(b"start")], dtype=np.uint32), np.array([n]))
    assert int(whole ^ int(shifted[0])) == zlib.crc32(b"x" * n)
