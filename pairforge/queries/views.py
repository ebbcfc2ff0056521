"""Input shapes of the library, made from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairforge.functions.text import EOS, PAD, SEP, training_text
from pairforge.operators.tokens import add_words, encode, vocabulary, with_specials
from pairforge.session import spread, stored

# Texts shared by both engines. Turn numbers stay below 2**32, so a pair id is
# unique and keeps the order of conversation and turn.
ASKED_SQL = """
SELECT u.conv_id * 4294967296 + u.turn AS pair_id, u.text AS src, a.text AS tgt
FROM (SELECT * FROM {conversations} WHERE role = 'user') u
LEFT JOIN (SELECT * FROM {conversations} WHERE role = 'assistant') a
  ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn
"""

RUNS_SQL = """
SELECT concat(CASE event_type
         WHEN 'click'    THEN concat('sft_padding_bs', CASE user_id % 3 WHEN 0 THEN '8' WHEN 1 THEN '16' ELSE '32' END,
                                     '_lr', CASE user_id % 2 WHEN 0 THEN '5e-05' ELSE '8e-05' END)
         WHEN 'view'     THEN concat('sft_dataset_packing_bs', CASE user_id % 3 WHEN 0 THEN '4' WHEN 1 THEN '8' ELSE '16' END,
                                     '_lr', CASE user_id % 2 WHEN 0 THEN '3e-05' ELSE '5e-05' END)
         WHEN 'purchase' THEN concat('sft_batch_packing_bs', CASE user_id % 3 WHEN 0 THEN '4' WHEN 1 THEN '8' ELSE '16' END,
                                     '_lr', CASE user_id % 2 WHEN 0 THEN '3e-05' ELSE '5e-05' END)
         WHEN 'signup'   THEN concat('dpo_final_model_lr', CASE user_id % 2 WHEN 0 THEN '1e-07' ELSE '3e-07' END)
         ELSE                 concat('ipo_final_model_lr', CASE user_id % 2 WHEN 0 THEN '1e-07' ELSE '3e-07' END) END,
       '_ep1_u', CAST(user_id AS VARCHAR(20))) AS experiment,
       concat('experiments/', event_type, '/', CAST(user_id AS VARCHAR(20))) AS checkpoint_path,
       CASE event_type WHEN 'click' THEN 'padding' WHEN 'view' THEN 'dataset_packing'
            WHEN 'purchase' THEN 'batch_packing' WHEN 'signup' THEN 'dpo' ELSE 'ipo' END AS cfg_method,
       CASE WHEN event_type IN ('signup', 'error') THEN 4 END AS cfg_batch_size,
       CASE WHEN event_type IN ('signup', 'error')
            THEN CASE user_id % 2 WHEN 0 THEN CAST('1e-07' AS DOUBLE) ELSE CAST('3e-07' AS DOUBLE) END
            END AS cfg_learning_rate,
       CAST(NULL AS INT) AS cfg_num_epochs,
       round(avg(value) / 100, 9) AS bleu_score,
       min(value) AS train_loss,
       CASE WHEN user_id % 10 = 0 THEN NULL ELSE max(value) END AS eval_loss,
       CAST(count(*) * 30 AS DOUBLE) AS training_time
FROM {events}
GROUP BY event_type, user_id
"""

# A log step stands for a thousand events; a record's place in its log is the
# event id.
LOGS_SQL = """
SELECT event_type AS run_kind, user_id, event_id AS place,
       100 * (1 + CAST(floor(event_id / 1000) AS BIGINT)) AS step,
       CASE WHEN event_id % 2 = 0 THEN 'train' ELSE 'eval' END AS kind,
       CASE WHEN event_id % 2 = 0 THEN value END AS loss,
       CASE WHEN event_id % 2 = 1 THEN value END AS eval_loss
FROM {events}
"""

LOGPS_SQL = """
SELECT pair_id, pair_id % 10 AS step,
       -CAST(length(src) AS DOUBLE) / 50 AS policy_chosen,
       -CAST(length(tgt) AS DOUBLE) / 60 AS policy_rejected,
       -CAST(length(src) AS DOUBLE) / 55 AS ref_chosen,
       -CAST(length(tgt) AS DOUBLE) / 58 AS ref_rejected,
       length(src) AS n_chosen, length(tgt) AS n_rejected
FROM {pairs}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the answer of the next turn, if there is one."""
    turns = spread(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return spark.sql(ASKED_SQL, conversations=turns)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns that the assistant answered in the next turn."""
    return asked(spark, sf_dir).where(F.col("tgt").isNotNull())


def fold(text: Column) -> Column:
    """ASCII only, so that both engines count the same edit distance."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", "?")


def candidates(asked_pairs: DataFrame) -> DataFrame:
    """Two made candidates per pair that reach every outcome."""
    kind = F.col("pair_id") % 7
    spelt = F.replace("g", F.lit("e"), F.lit("a"))
    pred1 = F.when(kind == 0, "").when(kind == 1, F.col("g")).otherwise(spelt)
    pred2 = (
        F.when(kind == 1, F.col("g"))
        .when(kind == 2, spelt)
        .when(kind == 3, F.concat(spelt, F.lit("x")))
        .when(kind == 4, F.regexp_replace("g", "[a-z ]", ""))
        .otherwise(F.replace(spelt, F.lit("th"), F.lit("d")))
    )
    return (
        asked_pairs.select("pair_id", "src", fold(F.col("tgt")).alias("g"))
        .select("pair_id", "src", F.col("g").alias("tgt"), pred1.alias("pred1"), pred2.alias("pred2"))
    )


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs as raw model output: padded, with one, two or no separators."""
    p = F.col("pair_id")
    raw = F.concat(
        F.when(p % 2 == 1, PAD).otherwise(""), "src",
        F.when(p % 5 == 1, "").otherwise(SEP), F.when(p % 5 == 0, f" {SEP} ").otherwise(" "),
        "tgt", F.lit(f"\n{EOS}"),
    )
    return pairs(spark, sf_dir).select("pair_id", "src", raw.alias("output"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RUNS_SQL, events=table(spark, sf_dir, "events"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LOGS_SQL, events=table(spark, sf_dir, "events"))


def logps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LOGPS_SQL, pairs=pairs(spark, sf_dir))


def planned_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs under the name of their plan row."""
    return runs(spark, sf_dir).select(
        F.regexp_replace("experiment", "_u[0-9]+$", "").alias("experiment_name"),
        F.col("experiment").alias("run_id"), "bleu_score",
        F.col("train_loss").alias("final_loss"), "eval_loss",
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, laid out for work on their texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return spread(docs, "doc_id")


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_words(documents(spark, sf_dir).select("doc_id", "text"), "text")


def edited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as references and an edited copy as predictions."""
    return documents(spark, sf_dir).select(
        "doc_id", "lang", "text", F.replace("text", F.lit(" the "), F.lit(" a ")).alias("pred")
    )


def encoded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = stored(document_words(spark, sf_dir), "words")
    return encode(tokens, "doc_id", "tokens", vocabulary(tokens))


def encoded_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Training texts of the pairs as ids, and the vocabulary."""
    texts = pairs(spark, sf_dir).select("pair_id", training_text(F.col("src"), F.col("tgt")).alias("text"))
    tokens = stored(add_words(texts, "text", [SEP, EOS]), "words")
    vocab = with_specials(vocabulary(tokens))
    return stored(encode(tokens, "pair_id", "tokens", vocab), "encoded"), vocab


def token_id(vocab: DataFrame, token: str) -> Column:
    return vocab.where(F.col("token") == token).select("token_id").scalar()
