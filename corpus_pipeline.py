"""Cleaning of the documents and packing of what is left, stage by stage.

1. language: documents without a letter go, and those of which no language has
   half of the letters;
2. lines: lines of templates that recur across documents go;
3. near: of documents that share 80 percent of their five-word shingles one stays;
4. repeats: strings of 200 bytes that occur twice go, whole characters only;
5. packing: what is left is packed into sequences of 1,024 tokens.

Every stage but the last returns the columns it was given, extra ones too. A
text that a stage empties goes with its document. Null, empty and repeated rows
are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairforge.llm import langid, line_dedup, minhash, packing, suffix_dedup
from pairforge.llm.common import Workspace, free_name, table

#: The share of a text's letters that its language must have.
OWN_LANGUAGE = 0.5
VOCABULARY = "byte_bpe_50k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pred, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    found = langid.with_language(docs, langid.learn(docs), pred, score)
    good = (F.col(pred) != "und") & (F.col(score) >= OWN_LANGUAGE)
    return found.where(good).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_dedup.drop_lines(docs)
    dropped = left.columns[-1]
    return left.where((F.col(dropped) == 0) | (F.length("text") > 0)).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("language", language), ("lines", lines), ("near", near), ("repeats", repeats), ("packing", pack)]
#: No stage but the last could be said in SQL; a test compares all with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that are left."""
    docs = table(spark, sf_dir, "documents")
    with Workspace(spark) as ws:
        for name, stage in STAGES[:-1]:
            docs = ws.stored(stage(spark, docs, sf_dir), f"stage-{name}")
        # The stages' own results belong to this workspace; only the pieces stay.
        return ws.keep(STAGES[-1][1](spark, docs, sf_dir), "pieces")
