"""Prompt → answer → label, with a pluggable labeller."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendlens.functions import answers, fixed
from trendlens.functions.text import has_keyword, joined_text

Labeller = Callable[[pd.Series], pd.Series]


def ask(df: DataFrame, labeller: Labeller, prompt: Column, out: str = "raw_resp") -> DataFrame:
    """Add a labeller's raw answers. It gets prompts in Arrow batches and returns
    as many texts, null for a prompt it could not answer; an exception fails the task."""

    @F.pandas_udf("string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield labeller(prompts)

    return df.withColumn(out, call(prompt))


def rule_answer(cols: list[str]) -> Column:
    """The default labeller, a column: stems of the games, then sport terms, else non-sport."""
    text = joined_text(cols)
    label = (
        F.when(has_keyword(text, fixed.GAMES_STEMS), "olympic")
        .when(has_keyword(text, fixed.SPORT_TERMS), "other_sport")
        .otherwise("non_sport")
    )
    return F.concat(F.lit('{"label":"'), label, F.lit('","reason":"keyword rule"}'))


def with_labels(
    df: DataFrame, parse: Callable[[DataFrame, str], DataFrame] = answers.with_json_answer, raw: str = "raw_resp"
) -> DataFrame:
    """Add label and reason. A null answer is a failed one: the row stays, marked so."""
    failed = F.col("_failed")
    parsed = parse(df.withColumn("_failed", F.col(raw).isNull()), raw)
    return parsed.withColumns({
        "label": F.when(failed, fixed.DEFAULT_LABEL).otherwise(F.col("label")),
        "reason": F.when(failed, fixed.FAILED_REASON).otherwise(F.col("reason")),
        raw: F.coalesce(F.col(raw), F.lit("")),
    }).drop("_failed")
