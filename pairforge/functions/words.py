"""BLEU words (mteval 13a rules), as column expressions and for Arrow arrays.

The patterns cost Java some ten times as much as Arrow's linear-time engine, so
work on whole corpora uses the Arrow form; both give the same words.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from pairforge.functions.text import WHITESPACE

# The published 13a rules, applied in this order. The first class
# leaves out the space, which the rules would only widen before the split.
UNESCAPE = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
SPACING = [
    (r"([\{-\~\[-\`!-\&\(-\+\:-\@\/])", r" $1 "),
    (r"([^0-9])([\.,])", r"$1 $2 "),
    (r"([\.,])([^0-9])", r" $1 $2"),
    (r"([0-9])(-)", r"$1 $2 "),
]
#: White space that is no plain space; the rules have replaced line feeds before.
ODD_SPACES = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE if c != " ") + "]"
MAX_N = 4


def spaced(text: Column) -> Column:
    """The text with plain spaces, and only these, between its words.

    The published splitter ends in a split at any Unicode white space; mapping
    all of it to the plain space is one pass without a pattern.
    """
    t = F.replace(text, F.lit("<skipped>"), F.lit(""))
    t = F.replace(t, F.lit("-\n"), F.lit(""))
    t = F.replace(t, F.lit("\n"), F.lit(" "))
    for entity, char in UNESCAPE:
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    for pattern, spread in SPACING:
        t = F.regexp_replace(t, pattern, spread)
    return F.translate(t, WHITESPACE, " " * len(WHITESPACE))


def spaced_array(texts: pa.Array) -> pa.Array:
    """``spaced`` for an array of texts; null texts are empty."""
    t = pc.fill_null(texts.cast(pa.large_string()), "")
    for old, new in [("<skipped>", ""), ("-\n", ""), ("\n", " "), *UNESCAPE]:
        t = pc.replace_substring(t, old, new)
    space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    t = pc.binary_join_element_wise(space, t, space, none)
    for pattern, spread in SPACING:
        t = pc.replace_substring_regex(t, pattern, spread.replace("$", "\\"))
    return pc.replace_substring_regex(t, ODD_SPACES, " ")


def split_words(parts: pa.Array, whole: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """All words of the parts one after the other, and the part of each.

    Parts marked in ``whole`` are one word as they stand.
    """
    t = spaced_array(parts)
    if whole is not None and whole.any():
        t = pc.if_else(pa.array(whole), parts.cast(pa.large_string()), t)
    split = pc.split_pattern(t, " ")
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = split.flatten()
    real = pc.not_equal(flat, pa.scalar("", pa.large_string()))
    return flat.filter(real), np.repeat(np.arange(len(t)), sizes)[real.to_numpy(zero_copy_only=False)]


def words(text: Column) -> Column:
    return F.array_remove(F.split(spaced(text), " "), "")


def words_and_specials(text: Column, specials: list[str]) -> Column:
    """Words of a formatted text, with the special tokens kept whole."""
    marks = "|".join(re.escape(s) for s in specials)
    parts = F.split(text, f"(?<={marks})|(?={marks})")
    return F.flatten(
        F.transform(parts, lambda p: F.when(p.isin(specials), F.array(p)).otherwise(words(p)))
    )
