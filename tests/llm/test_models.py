"""Language and quality: accuracy on held-out rows, and defined results for odd rows."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pairforge.llm import langid, quality
from pairforge.llm.common import Workspace, held_out


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_op8_on_held_out_rows(query, docs):
    langs = {r.doc_id: r.lang for r in docs.collect()}
    rows = query(8).collect()
    assert len(rows) == len(langs) and all(r.held_out == is_held_out(r.doc_id) for r in rows)
    good = [langs[r.doc_id] == r.lang_pred for r in rows if r.held_out]
    assert len(good) > 20 and np.mean(good) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixed_texts_get_spans(spark, docs):
    model = langid.learn(docs)
    own = {lang: docs.where((F.col("lang") == lang) & (F.length("text") > 800)).first().text for lang in ("en", "fr")}
    mixed = own["en"][:500] + " " + own["fr"][:300]
    df = spark.createDataFrame([(1, mixed), (2, own["fr"])], "doc_id bigint, text string")
    found = {r.doc_id: r for r in langid.identify(df, model, spans=True).collect()}
    assert [s.lang for s in found[1].spans] == ["en", "fr"] and found[1].lang_pred == "en"
    assert 0.5 < found[1].score < 0.75 and [s.lang for s in found[2].spans] == ["fr"]


def test_viterbi_is_the_best_sequence():
    rng = np.random.default_rng(0)
    sizes = np.array([5, 0, 1, 7, 3])
    scores = rng.normal(size=(sizes.sum(), 3)) * 3
    labels = langid.viterbi(scores, sizes, 2.0)
    at = 0
    for n in sizes:
        own = scores[at : at + n]
        best = max(
            (sum(own[i, s[i]] for i in range(n)) - 2.0 * sum(a != b for a, b in zip(s, s[1:])), s)
            for s in np.ndindex(*[3] * n)
        ) if n else (0, ())
        assert tuple(labels[at : at + n]) == best[1]
        at += n


def test_scripts_narrow_the_candidates(spark):
    rows = [(i, "слово и дело", "ru") for i in range(20)] + [(100 + i, "word and deed", "en") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.learn(df)
    asked = spark.createDataFrame([(1, "zzz ййй ъъъ ъъ"), (2, "漢字"), (3, "123")], "doc_id bigint, text string")
    found = {r.doc_id: r.lang_pred for r in langid.identify(asked, model).collect()}
    assert found[1] == "ru" and found[2] in ("en", "ru") and found[3] == "und"


def test_odd_rows_language(odd, no_docs):
    model = langid.learn(odd)
    found = langid.with_language(odd, model, "lang_", "score_")
    assert found.columns == [*odd.columns, "lang_", "score_"]
    by_text = {r.text: r for r in found.collect()}
    assert all(by_text[t].lang_ == "und" and by_text[t].score_ == 0 for t in (None, "", " \t\n ", "12 34 !!"))
    assert by_text["one"].lang_ in model.langs
    empty = langid.learn(no_docs)
    assert empty.langs == [] and {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}
    assert langid.identify(no_docs, model).count() == 0


def test_op6_on_held_out_rows(spark, sf, query):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = query(6).collect()
    assert all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= 0.7) for r in rows)
    own = [(labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for q, s in own if q], [s for q, s in own if not q]
    assert np.mean([a > b for a in good for b in bad] or [1]) > 0.95


def test_rules_are_sparse_and_equal_their_column(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    with Workspace(spark) as ws:
        scored, rules = quality.score(docs, labels, ws)
        assert 1 < len(rules) < quality.TREES * (2 << quality.DEPTH)
        for r in scored.limit(50).collect():
            total = sum(
                w for rule, w in rules if all((r[s] <= b) if low else (r[s] > b) for s, low, b in rule)
            )
            assert abs(r.score - 1 / (1 + np.exp(-total))) < 1e-9


def test_statistics_by_hand():
    found = quality.statistics(pa.array(["Aa a!! a a\nb1 | x*\nb1 | x*", None, ""]))
    assert found["n_words"].tolist() == [10, 0, 0]
    assert found["next_equal"][0] == 0.1 and found["top_word"][0] == 0.2 and found["distinct_words"][0] == 0.6
    assert found["distinct_lines"][0] == 2 / 3 and found["marked_words"][0] == 0.2
    assert found["upper"][0] == 1 / 26 and found["bars"][0] == 2 / 26 and found["exclaims"][0] == 2 / 26


def test_odd_rows_and_labels(spark, odd, no_docs):
    schema = "doc_id bigint, quality int, toxic int"
    none = quality.score_all(odd, spark.createDataFrame([], schema)).collect()
    assert len(none) == odd.count() and {r.score for r in none} == {0.5}
    one = spark.createDataFrame([(1, 1, None), (1, None, 0), (None, 0, 0), (999, 0, 0)], schema)
    assert {round(r.score, 5) for r in quality.score_all(odd, one).collect()} == {1.0}
    assert quality.score_all(no_docs, one).count() == 0
    ids = [r.h for r in odd.select(held_out().alias("h")).collect()]
    assert None not in ids
