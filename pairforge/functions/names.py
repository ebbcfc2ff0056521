"""Run names: building, parsing, and the display form of their fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sft_name(method: Column, effective_batch: Column, lr_text: Column, epochs: Column) -> Column:
    """``lr_text`` is text because 8e-05 has many spellings and one is wanted."""
    return F.concat(
        F.lit("sft_"), method, F.lit("_bs"), effective_batch.cast("string"),
        F.lit("_lr"), lr_text, F.lit("_ep"), epochs.cast("string"),
    )


def preference_name(method: Column, model_path: Column, lr_text: Column, epochs: Column) -> Column:
    last = F.element_at(F.split(model_path, "/"), -1)
    return F.concat(
        method, F.lit("_"), last, F.lit("_lr"), lr_text, F.lit("_ep"), epochs.cast("string")
    )


def is_preference_run(name: Column) -> Column:
    return name.startswith("dpo_") | name.startswith("ipo_")


def _tagged(parts: Column, tag: str) -> Column:
    """Texts behind ``tag`` in the parts that start with it, in order."""
    hits = F.filter(parts, lambda p: p.startswith(tag))
    return F.transform(hits, lambda p: F.substr(p, F.lit(len(tag) + 1)))


def parse_name(name: Column) -> Column:
    """A struct of base_method, batch_size, learning_rate, epochs,
    final_method and final_lr; a field the name does not give is null."""
    parts = F.split(name, "_")
    tail = F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0)))
    sft = name.startswith("sft_") & (F.size(parts) >= 4)
    pref = is_preference_run(name)
    bases = F.filter(parts, lambda p: p.isin("padding", "packing"))

    def last(tag: str) -> Column:
        return F.try_element_at(_tagged(tail, tag), F.lit(-1))

    def nth(tag: str, n: int) -> Column:
        return F.try_element_at(_tagged(parts, tag), F.lit(n))

    def pick(for_sft: Column, for_pref: Column | None, kind: str) -> Column:
        value = F.when(sft, for_sft)
        if for_pref is not None:
            value = value.when(pref, for_pref)
        return value.try_cast(kind)

    return F.struct(
        pick(F.get(parts, F.lit(1)), F.try_element_at(bases, F.lit(-1)), "string").alias("base_method"),
        pick(last("bs"), nth("bs", 1), "int").alias("batch_size"),
        pick(last("lr"), nth("lr", 1), "double").alias("learning_rate"),
        pick(last("ep"), nth("ep", 1), "int").alias("epochs"),
        pick(F.lit("SFT"), F.upper(F.get(parts, F.lit(0))), "string").alias("final_method"),
        F.when(pref, nth("lr", 2)).try_cast("double").alias("final_lr"),
    )


def printed(value: Column, digits: str) -> Column:
    """A number in Python's own form, which rounds what the double is.

    ``format_string`` rounds its shortest decimal spelling, halves up, so 1.25505
    to four digits was 1.2551 where the double lies below that half.
    """
    return F.udf(lambda x: None if x is None else format(x, digits), "string")(value)


def short_rate(rate: Column) -> Column:
    """One digit after the point and a two-digit exponent; null as ``-``."""
    return F.when(rate.isNotNull(), printed(rate, ".1e")).otherwise("-")


def rate_text(rate: Column) -> Column:
    """The shortest spelling, such as 1e-07 or 0.0001; null as ``-``."""
    digits = F.regexp_replace(F.split(rate.cast("string"), "E")[0], r"\.0$", "")
    exponent = F.get(F.split(rate.cast("string"), "E"), F.lit(1)).cast("int")
    tiny = F.concat(digits, F.lit("e-"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    small = F.regexp_replace(rate.cast("decimal(38,20)").cast("string"), "0+$", "")
    return (
        F.when(rate.isNull(), "-")
        .when((F.abs(rate) < 1e-4) & (rate != 0), tiny)
        .when((F.abs(rate) < 1e-3) & (rate != 0), small)
        .otherwise(rate.cast("string"))
    )


def numeric_rate(rate: Column) -> Column:
    """A learning rate given as text; ``-``, ``unknown`` and other text as null."""
    return rate.try_cast("double")
