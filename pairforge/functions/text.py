"""Formatting of training text and clean-up of generated text."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Special tokens of the published tokenizer, and their ids.
SEP = "[SEP]"
EOS = "<|endoftext|>"
PAD = "[PAD]"
PAD_ID = 49152
SEP_ID = 49153
EOS_ID = 0

# The characters that Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def training_text(source: Column, target: Column, sep: str = SEP, eos: str = EOS) -> Column:
    return F.concat(source, F.lit(sep), target, F.lit(eos))


def prompt_text(source: Column, sep: str = SEP) -> Column:
    return F.concat(source, F.lit(sep))


def references(target: Column) -> Column:
    """The stripped target as a list of one reference."""
    return F.array(strip(target))


def answer(
    output: Column,
    prompt: Column | None = None,
    sep: str = SEP,
    eos: str = EOS,
    pad: str | None = PAD,
) -> Column:
    """The answer part of a generated text.

    End and pad tokens go first; then everything after the first separator
    counts. Without a separator the cleaned text itself is the answer, less
    the prompt when one is given.
    """
    clean = strip(F.replace(output, F.lit(eos), F.lit("")))
    if pad:
        clean = strip(F.replace(clean, F.lit(pad), F.lit("")))
    after = F.get(F.split(clean, re.escape(sep), 2), F.lit(1))
    whole = clean
    if prompt is not None:
        whole = strip(F.replace(clean, F.coalesce(prompt, F.lit("")), F.lit("")))
    return F.coalesce(strip(after), whole)


def length_ratio(chosen: Column, rejected: Column) -> Column:
    """Characters of the chosen text per character of the rejected one."""
    return F.length(chosen).cast("double") / F.length(rejected)
