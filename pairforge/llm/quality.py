"""Quality scores by a sparse ensemble of rules over text statistics.

Statistics of every whole text are computed where it is scanned. On the
labelled rows that may be learned from, a forest of shallow trees is grown; the
path to each of their nodes, root excepted, is a rule: a conjunction of
comparisons. A logistic regression with a lasso penalty gives most rules the
weight zero. What is left is one Spark column expression over the statistics.

Forest and regression run on all labelled rows, on the cluster. Nothing but
the rules comes to the driver; trees of ``DEPTH`` levels bound their number.

Cases: null and empty texts have the statistics of an empty text and are
scored like any other; null labels, and labels of ids without a document, are
not learned; an id with several labels counts with each; without labels of
both kinds every score is the share of label 1, or 0.5 without any label; rows
that repeat get the same score; texts are read whole, in slices of ``TOGETHER``
bytes, and a very long one alone; other columns are never read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from pairforge.llm.common import Workspace, arrow_map, held_out, text_slices

TREES = 24
DEPTH = 3
BINS = 64
LASSO = 5e-4
ITERATIONS = 60
SEED = 7
GOOD = 0.7
#: Bytes of text whose statistics are worked out together, or one text.
TOGETHER = 1 << 20

STATISTICS = (
    "n_words", "word_length", "upper", "digits", "symbols", "exclaims", "bars", "commas", "stops",
    "distinct_words", "next_equal", "top_word", "words_per_line", "distinct_lines", "spaces", "marked_words",
)


def _classes() -> np.ndarray:
    """One bit per class of a byte; bytes beyond ASCII count as letters."""
    table = np.zeros(256, dtype=np.int64)
    for b in range(128):
        c = chr(b)
        table[b] |= c.isupper() | c.isdigit() << 1 | c.isspace() << 3
        table[b] |= (not c.isalnum() and not c.isspace() and c not in ".,'!|") << 2
        table[b] |= (c == "!") << 4 | (c == "|") << 5 | (c == ",") << 6 | (c == ".") << 7
    return table


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """``STATISTICS`` of each text; shares are of bytes, words or lines."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = np.frombuffer("".join(texts.to_pylist()).encode(), dtype=np.uint8)
    of_byte = np.repeat(np.arange(n), size)
    classes = _classes()[joined]
    some = np.maximum(size, 1)

    def share(bit: int) -> np.ndarray:
        return np.bincount(of_byte, weights=(classes >> bit) & 1, minlength=n) / some

    split = pc.utf8_split_whitespace(texts)
    words = split.flatten()
    there = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    of_word = np.repeat(np.arange(n), sizes)[there]
    code = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[there]
    marked = pc.match_substring_regex(words, r"[^\w\s.,!|']$").to_numpy(zero_copy_only=False)[there]
    n_words = np.bincount(of_word, minlength=n)
    all_words = np.maximum(n_words, 1)
    equal = np.zeros(len(code), dtype=bool)
    equal[1:] = (code[1:] == code[:-1]) & (of_word[1:] == of_word[:-1])

    def distinct(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = owner * (int(value.max()) + 1 if len(value) else 1) + value
        unique, times = np.unique(keys, return_counts=True)
        owner_ = unique // (int(value.max()) + 1) if len(value) else unique
        top = np.zeros(n, dtype=np.int64)
        np.maximum.at(top, owner_, times)
        return np.bincount(owner_, minlength=n), top

    kinds, top = distinct(of_word, code)
    lines = pc.split_pattern(texts, "\n")
    line_sizes = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    line = lines.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    line_kinds, _ = distinct(np.repeat(np.arange(n), line_sizes), line)
    return {
        "n_words": n_words.astype(float),
        "word_length": size / all_words,
        "upper": share(0), "digits": share(1), "symbols": share(2), "spaces": share(3),
        "exclaims": share(4), "bars": share(5), "commas": share(6), "stops": share(7),
        "distinct_words": kinds / all_words,
        "next_equal": np.bincount(of_word, weights=equal, minlength=n) / all_words,
        "top_word": top / all_words,
        "marked_words": np.bincount(of_word, weights=marked, minlength=n) / all_words,
        "words_per_line": n_words / np.maximum(line_sizes, 1),
        "distinct_lines": line_kinds / np.maximum(line_sizes, 1),
    }


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out`` and the statistics of every row."""

    def make():
        def each(batch: pa.RecordBatch):
            for at, n in text_slices(batch.column(2), TOGETHER):
                some = batch.slice(at, n)
                found = statistics(some.column(2))
                yield {"doc_id": some.column(0), "held_out": some.column(1)} | found

        return each

    schema = "doc_id bigint, held_out boolean, " + ", ".join(f"{s} double" for s in STATISTICS)
    return arrow_map(docs.select("doc_id", held_out().alias("held_out"), "text"), make, schema)


Rule = tuple[tuple[str, bool, float], ...]


def tree_rules(trees) -> list[Rule]:
    """The path to every node below a root, as conditions ``(statistic, at most, bound)``."""
    found: dict[Rule, None] = {}

    def walk(node, path: Rule) -> None:
        if path:
            found.setdefault(path)
        if node.subtreeDepth():
            split = node.split()
            name, bound = STATISTICS[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), (*path, (name, True, bound)))
            walk(node.rightChild(), (*path, (name, False, bound)))

    for tree in trees:
        walk(tree._call_java("rootNode"), ())
    return list(found)


def rule_column(rule: Rule) -> Column:
    parts = [F.col(s) <= F.lit(b) if low else F.col(s) > F.lit(b) for s, low, b in rule]
    return reduce(lambda a, b: a & b, parts)


def learn(labelled: DataFrame) -> list[tuple[Rule, float]]:
    """Rules with their weights from statistics with a 0 or 1 ``label``; the empty rule has the intercept."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    n, good = labelled.agg(F.count("label"), F.sum("label")).first()
    if not n or good in (0, n):
        share = min(max(good / n if n else 0.5, 1e-6), 1 - 1e-6)
        return [((), float(np.log(share / (1 - share))))]
    rows = VectorAssembler(inputCols=list(STATISTICS), outputCol="stats").transform(labelled)
    forest = RandomForestClassifier(
        featuresCol="stats", labelCol="label", numTrees=TREES, maxDepth=DEPTH, maxBins=BINS, seed=SEED,
        featureSubsetStrategy="onethird",
    ).fit(rows.select("stats", "label"))
    rules = tree_rules(forest.trees)
    fires = F.array(*[rule_column(r).cast("double") for r in rules])
    from pyspark.ml.functions import array_to_vector

    lasso = LogisticRegression(
        featuresCol="fires", labelCol="label", elasticNetParam=1.0, regParam=LASSO, maxIter=ITERATIONS,
        standardization=False,
    ).fit(labelled.select(array_to_vector(fires).alias("fires"), "label"))
    weights = lasso.coefficients.toArray()
    kept = [(r, float(w)) for r, w in zip(rules, weights) if w]
    return [((), float(lasso.intercept)), *kept]


def score_column(rules: list[tuple[Rule, float]]) -> Column:
    """The rules compiled into one expression between 0 and 1."""
    terms = [F.when(rule_column(r), F.lit(w)).otherwise(F.lit(0.0)) if r else F.lit(w) for r, w in rules]
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-reduce(lambda a, b: a + b, terms)))


def score(docs: DataFrame, labels: DataFrame, ws: Workspace) -> tuple[DataFrame, list[tuple[Rule, float]]]:
    """``doc_id, held_out, score, predicted`` and statistics of every row; and the rules."""
    kept = ws.stored(with_statistics(docs), "statistics")
    labelled = kept.where(~F.col("held_out")).join(
        labels.where(F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("double").alias("label")),
        "doc_id",
    )
    rules = learn(ws.stored(labelled.select("label", *STATISTICS), "labelled"))
    scored = kept.withColumn("score", score_column(rules))
    return scored.withColumn("predicted", (F.col("score") >= GOOD).cast("int")), rules


def score_all(docs: DataFrame, labels: DataFrame) -> DataFrame:
    with Workspace(docs.sparkSession) as ws:
        scored, _ = score(docs, labels, ws)
        return ws.keep(scored.select("doc_id", "held_out", "score", "predicted"), "quality")
