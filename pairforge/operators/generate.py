"""Candidates from a user's own text generator."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from pairforge.functions.text import EOS, answer, prompt_text

Generator = Callable[[list[str], dict], list[str]]

BATCH = 128
# The two published settings.
SETTINGS = [
    {"max_new_tokens": 128, "temperature": 0.3, "do_sample": True, "top_p": 0.7, "repetition_penalty": 1.05},
    {"max_new_tokens": 128, "temperature": 0.7, "do_sample": True, "top_p": 0.9, "repetition_penalty": 1.15},
]


def _generate(fn: Generator, prompts: list[str], setting: dict) -> tuple[list, list]:
    """Texts and errors; a failing batch is run again row by row."""
    try:
        texts = list(fn(prompts, setting))
        if len(texts) != len(prompts):
            raise ValueError(f"{len(texts)} texts for {len(prompts)} prompts")
        return texts, [None] * len(texts)
    except Exception as failure:
        if len(prompts) == 1:
            return [None], [f"{type(failure).__name__}: {failure}"]
    rows = [_generate(fn, [p], setting) for p in prompts]
    return [t[0] for t, _ in rows], [e[0] for _, e in rows]


def with_candidates(
    df: DataFrame, make_generator: Callable[[], Generator], source: str = "src",
    settings: list[dict] = SETTINGS, batch_size: int = BATCH,
) -> DataFrame:
    """Add ``pred1``, ``pred2`` and ``gen_error`` by one pass over the table.

    ``make_generator`` runs once per task, so a model is loaded there. Both
    settings run on each batch; a row that fails keeps its error text.
    """
    prompts = df.withColumn("_prompt", prompt_text(F.col(source)))
    raw = [f"_raw{i}" for i in range(1, len(settings) + 1)]
    schema = T.StructType(
        prompts.schema.fields
        + [T.StructField(c, T.StringType()) for c in raw]
        + [T.StructField("gen_error", T.StringType())]
    )

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generator = make_generator()
        for part in parts:
            for at in range(0, len(part), batch_size):
                batch = part.iloc[at : at + batch_size].copy()
                live = batch["_prompt"].notna()
                texts = batch.loc[live, "_prompt"].tolist()
                errors = pd.Series([None] * len(batch), index=batch.index, dtype=object)
                for name, setting in zip(raw, settings):
                    out, failed = _generate(generator, texts, setting) if texts else ([], [])
                    batch[name] = pd.Series([None] * len(batch), index=batch.index, dtype=object)
                    batch.loc[live, name] = out
                    errors.loc[live] = [a or b for a, b in zip(errors.loc[live], failed)]
                batch["gen_error"] = errors
                yield batch

    made = prompts.mapInPandas(run, schema)
    return made.select(
        *df.columns,
        *[answer(F.col(c), F.col("_prompt")).alias(f"pred{i}") for i, c in enumerate(raw, 1)],
        "gen_error",
    )


def letter_editor() -> Generator:
    """A deterministic stand-in for a model: two spellings of the source."""

    def edit(prompts: list[str], setting: dict) -> list[str]:
        texts = [p.replace("e", "a") for p in prompts]
        if setting["temperature"] > 0.5:
            texts = [t.replace("th", "d") for t in texts]
        return [p + t.replace("[SEP]", "") + EOS for p, t in zip(prompts, texts)]

    return edit


def with_stored_candidates(pairs: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Candidates made elsewhere, matched to their sources by row id.

    A source without stored candidates stays, with nulls: it is judged empty.
    """
    return pairs.join(candidates, key, "left")
