"""Candidate records: keyword filter, games filter with caps, samples for labelling."""

from __future__ import annotations

from pyspark.sql import DataFrame

from trendlens.functions import fixed
from trendlens.functions.text import has_keyword, joined_text
from trendlens.operators.lookups import exclude_signed
from trendlens.operators.ranking import take_first
from trendlens.operators.sampling import sample_per_country, sample_rows
from trendlens.session import attach_small, settle



def keyword_candidates(
    records: DataFrame, terms: list[str] = fixed.SPORT_TERMS, columns: list[str] = fixed.TEXT_COLUMNS
) -> DataFrame:
    """Records with a term in any of the text columns that exist."""
    present = [c for c in columns if c in records.columns]
    return records.filter(has_keyword(joined_text(present), terms)) if present else records.limit(0)


def capped_candidates(
    records: DataFrame,
    order: list[str],
    key: list[str],
    terms: list[str] = fixed.GAMES_STEMS,
    columns: list[str] = fixed.GAMES_COLUMNS,
    per_country: int = fixed.PER_COUNTRY,
    overall: int = fixed.OVERALL,
    seed: int = 42,
) -> DataFrame:
    """Games candidates, the first ``per_country`` of each country, then a uniform
    sample of ``overall`` if there are more. Without a country column: the first ``overall``."""
    found = keyword_candidates(records, terms, columns)
    if "country_code" not in records.columns:
        return found.orderBy(*order).limit(overall)
    # matching is the costly part; the passes below read its result, keys and order only
    narrow = settle(found.select(*dict.fromkeys([*key, *order, "country_code"])))
    drawn = sample_rows(take_first(narrow, ["country_code"], order, per_country), key, overall, seed).select(*key)
    return attach_small(records, drawn, key, "inner").select(records.columns)


def labelling_samples(
    candidates: DataFrame,
    records: DataFrame,
    key: list[str],
    pos_per_country: int = 500,
    neg_per_country: int = 500,
    seed: int = 0,
    fields: tuple[str, ...] = ("title", "channelTitle", "publish_time"),
) -> tuple[DataFrame, DataFrame]:
    """Positives from the candidates, negatives from records that are no candidate.

    Pass candidates that are a table, or settled: they are read three times.
    """
    positives = sample_per_country(candidates, key, pos_per_country, seed)
    # the exclusion shuffles keys only; the few records drawn are fetched afterwards
    narrow = exclude_signed(records, candidates, fields).select(*key, "country_code")
    drawn = sample_per_country(settle(narrow), key, neg_per_country, seed).select(*key)
    return positives, attach_small(records, drawn, key, "inner").select(records.columns)


def preview(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
