import random

from pyspark.sql import functions as F

from pairforge.functions import names, text
from pairforge.functions.words import words, words_and_specials
from pairforge.operators import tokens


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression.alias("y")).first()["y"]


def test_training_and_prompt_text(spark):
    row = spark.createDataFrame([("a b", "c")], "s string, t string").select(
        text.training_text(F.col("s"), F.col("t")).alias("full"), text.prompt_text(F.col("s")).alias("p")
    ).first()
    assert row["full"] == "a b[SEP]c<|endoftext|>"
    assert row["p"] == "a b[SEP]"


def test_strip_removes_what_python_strips(spark):
    every = "".join(chr(i) for i in range(0x10000) if chr(i).isspace())
    assert one(spark, every + "x​y" + every, text.strip(F.col("x"))) == "x​y"
    assert one(spark, "\xa0x ", text.strip(F.col("x"))) == "x"


def test_answer(spark):
    def answer(output, prompt=None):
        return one(spark, output, text.answer(F.col("x"), None if prompt is None else F.lit(prompt)))

    assert answer("a[SEP]b[SEP]c<|endoftext|>") == "b[SEP]c"
    assert answer(" x <|endoftext|>") == "x"
    assert answer(" x <|endoftext|>", "x") == ""
    assert answer("[PAD][PAD]q[SEP] a\n<|endoftext|>[PAD]") == "a"
    assert answer("q[SEP]") == ""
    assert answer("say it again", "") == "say it again"


def test_references_are_stripped_lists(spark):
    assert one(spark, " a ", text.references(F.col("x"))) == ["a"]


def test_words(spark):
    assert one(spark, 'He said &quot;3.5-4, no.&quot;', words(F.col("x"))) == [
        "He", "said", '"', "3.5", "-", "4", ",", "no", ".", '"'
    ]
    assert one(spark, "well-\nknown", words(F.col("x"))) == ["wellknown"]
    assert one(spark, "  ", words(F.col("x"))) == []


def test_words_keep_specials(spark):
    got = one(spark, "a.[SEP]b<|endoftext|>", words_and_specials(F.col("x"), [text.SEP, text.EOS]))
    assert got == ["a", ".", "[SEP]", "b", "<|endoftext|>"]


def test_both_forms_give_the_same_words(spark):
    rng = random.Random(12)
    signs = ["a", "Bc", "é", "7", "12", ".", ",", "-", "-\n", "\n", "&quot;", "&amp;lt;", "<skipped>", "!", "{", "'", "日"]
    signs += [" ", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "[SEP]", "<|endoftext|>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(500)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, x string").repartition(3)
    specials = [text.SEP, text.EOS]
    for own, given in ((words(F.col("x")), []), (words_and_specials(F.col("x"), specials), specials)):
        column = {r["id"]: r["y"] or [] for r in df.select("id", own.alias("y")).collect()}
        arrow = {r["id"]: r["y"] for r in tokens.add_words(df, "x", given, "y").collect()}
        assert arrow == column


def test_words_part_at_what_python_parts_at(spark):
    every = "".join(chr(i) for i in range(0x10000) if chr(i).isspace() and chr(i) != "\n")
    assert one(spark, "x".join(every), words(F.col("x"))) == ["x"] * (len(every) - 1)


def parsed(spark, name):
    return one(spark, name, names.parse_name(F.col("x"))).asDict()


def test_parse_name(spark):
    assert parsed(spark, "sft_dataset_packing_bs4_lr5e-05_ep1") == {
        "base_method": "dataset", "batch_size": 4, "learning_rate": 5e-05, "epochs": 1,
        "final_method": "SFT", "final_lr": None,
    }
    assert parsed(spark, "dpo_sft_padding_bs32_lr5e-5_ep1_lr3e-7_ep1") == {
        "base_method": "padding", "batch_size": 32, "learning_rate": 5e-05, "epochs": 1,
        "final_method": "DPO", "final_lr": 3e-07,
    }
    assert parsed(spark, "ipo_final_model_lr1e-07_ep2") == {
        "base_method": None, "batch_size": None, "learning_rate": 1e-07, "epochs": 2,
        "final_method": "IPO", "final_lr": None,
    }
    assert set(parsed(spark, "sft_padding_bs4").values()) == {None}
    assert set(parsed(spark, "other").values()) == {None}


def test_parse_name_last_or_first_wins(spark):
    assert parsed(spark, "sft_padding_bs4_bs8_lr1e-5")["batch_size"] == 8
    assert parsed(spark, "dpo_x_bs4_bs8_lr1e-5")["batch_size"] == 4


def test_built_names_parse_back(spark):
    row = spark.range(1).select(
        names.sft_name(F.lit("padding"), F.lit(64), F.lit("8e-05"), F.lit(1)).alias("s"),
        names.preference_name(F.lit("dpo"), F.lit("runs/best/final_model"), F.lit("3e-07"), F.lit(1)).alias("p"),
    ).first()
    assert row["s"] == "sft_padding_bs64_lr8e-05_ep1"
    assert row["p"] == "dpo_final_model_lr3e-07_ep1"


def test_rate_text_is_pythons(spark):
    rates = [1e-07, 3e-07, 5e-05, 1.25e-05, 1e-04, 0.00012, 0.001, 0.5, 2.0]
    rows = spark.createDataFrame([(r,) for r in [*rates, None]], "x double").select(
        names.rate_text(F.col("x")).alias("r"), names.short_rate(F.col("x")).alias("s")
    ).collect()
    assert [r["r"] for r in rows] == [str(r) for r in rates] + ["-"]
    assert [r["s"] for r in rows] == [f"{r:.1e}" for r in rates] + ["-"]


def test_numeric_rate(spark):
    assert one(spark, "1e-07", names.numeric_rate(F.col("x"))) == 1e-07
    for bad in ("-", "unknown", "x"):
        assert one(spark, bad, names.numeric_rate(F.col("x"))) is None


def test_words_split_at_unicode_white_space(spark):
    df = spark.createDataFrame([("a\u00a0b\u3000c\u2028d\x1ce f\u202f:",)], "t string")
    assert df.select(words(F.col("t"))).first()[0] == ["a", "b", "c", "d", "e", "f", ":"]


def test_a_tokenizer_gets_bounded_texts(spark):
    from pairforge.operators import tokens
    from pairforge.operators.arrow import SLICE

    def sizes():
        return lambda texts: [[sum(map(len, texts))] for _ in texts]

    df = spark.range(40, numPartitions=1).select(F.repeat(F.lit("x"), 200_000).alias("text"))
    got = [r["ids"][0] for r in tokens.encode_with(df, "text", sizes).collect()]
    assert len(got) == 40 and max(got) <= SLICE
