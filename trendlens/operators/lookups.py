"""Lookup, fallback lookup and exclusion joins.

Sides are not hinted: dimensions grow with the data, so sizes decide between
broadcast and shuffle. Hot keys of the probing side are split.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendlens.functions import fixed
from trendlens.functions.text import signature
from trendlens.operators.dedupe import keep_first
from trendlens.session import join_hot, settle


def first_seen(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, value): the first non-null value seen for each non-null key."""
    known = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull())
    return keep_first(known, [key], order, keep=[key, value], codes=(value,))


def _without(df: DataFrame, col: str) -> DataFrame:
    return df.drop(col) if col in df.columns else df


def _signed(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Add the record signature; a field the table lacks counts as empty."""
    absent = {c: F.lit(None).cast("string") for c in fields if c not in df.columns}
    return df.withColumns(absent).withColumn("_sig", signature(list(fields))).drop(*absent)


def lookup_country(
    candidates: DataFrame,
    records: DataFrame,
    order: list[str],
    key: str = "video_id",
    country: str = "country_code",
    default: str = fixed.NO_COUNTRY,
) -> DataFrame:
    """Candidates with the country first seen for their key; row count is kept."""
    known = first_seen(records, key, country, order)
    joined = join_hot(_without(candidates, country), known, [key])
    filled = F.coalesce(F.col(country).cast("string"), F.lit(default)).alias(country)
    return joined.select(*[c for c in candidates.columns if c != country], filled)


def lookup_country_or_signature(
    candidates: DataFrame,
    records: DataFrame,
    order: list[str],
    key: str = "video_id",
    country: str = "country_code",
    fields: tuple[str, ...] = ("title", "channelTitle", "publish_time"),
    default: str = fixed.NO_COUNTRY,
) -> DataFrame:
    """As ``lookup_country``; keys that miss are looked up by record signature."""
    by_key = first_seen(records, key, country, order).withColumnRenamed(country, "_by_key")
    by_sig = first_seen(_signed(records, fields), "_sig", country, order).withColumnRenamed(country, "_by_sig")
    joined = join_hot(_signed(_without(candidates, country), fields), by_key, [key])
    joined = join_hot(joined, by_sig, ["_sig"])
    filled = F.coalesce(F.col("_by_key").cast("string"), F.col("_by_sig").cast("string"), F.lit(default))
    return joined.select(*[c for c in candidates.columns if c != country], filled.alias(country))


def annotate_country(
    candidates: DataFrame,
    records: DataFrame,
    order: list[str],
    use_signature_if_missing: bool = False,
    key: str = "video_id",
    country: str = "country_code",
    fields: tuple[str, ...] = ("title", "channelTitle", "publish_time"),
) -> DataFrame:
    """Country for candidates by the best key both tables have: the video id, with the
    signature as an optional fallback, or the signature alone."""
    if key in candidates.columns and key in records.columns:
        if use_signature_if_missing:
            return lookup_country_or_signature(candidates, records, order, key, country, fields)
        return lookup_country(candidates, records, order, key, country)
    found = lookup_country(_signed(candidates, fields), _signed(records, fields), order, "_sig", country)
    return found.drop("_sig")


BLOOM_BITS = 28  # at most 32 MB are sent to the executors
PER_KEY, PROBES = 10, 4  # bits a key and probes: about one record in a hundred is looked up in vain


def _probes(width: int) -> list[Column]:
    """Places of a signature among 2^width bits: its first hex digits, seven for each probe."""
    return [F.conv(F.substring("_sig", 1 + 7 * i, 7), 16, 10).cast("long").bitwiseAND(F.lit((1 << width) - 1)) for i in range(PROBES)]


def bloom_filter(taken: DataFrame, max_bits: int = BLOOM_BITS) -> np.ndarray | None:
    """A Bloom filter of the signatures as 64-bit words, put together by the executors; None if it would be too big to be of use."""
    n = taken.count()
    width = max(10, (PER_KEY * n).bit_length())
    if width > max_bits:
        return None
    words = taken.select(F.explode(F.array(*_probes(width))).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(1 << (width - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def exclude_signed(
    records: DataFrame, candidates: DataFrame, fields: tuple[str, ...] = ("title", "channelTitle", "publish_time"),
    max_bits: int = BLOOM_BITS,
) -> DataFrame:
    """Records whose signature is not among the candidates'.

    A Bloom filter of the candidates' signatures passes most records on where they are; only those it hits are shuffled
    and looked up. With too many candidates for a filter of ``max_bits`` all are.
    """
    taken = settle(_signed(candidates, fields).select("_sig").distinct())
    signed = _signed(records, fields)
    bits = bloom_filter(taken, max_bits)
    if bits is None:
        return join_hot(signed, taken, ["_sig"], "left_anti").drop("_sig")
    sent, width = records.sparkSession.sparkContext.broadcast(bits), (64 * len(bits)).bit_length() - 1

    @F.pandas_udf("boolean")
    def hit(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        found = np.ones(len(a), bool)
        for at in (x.to_numpy() for x in (a, b, c, d)):
            found &= (sent.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return pd.Series(found)

    maybe = hit(*_probes(width))
    looked_up = join_hot(signed.filter(maybe), taken, ["_sig"], "left_anti")
    return signed.filter(~maybe).unionByName(looked_up.select(signed.columns)).drop("_sig")
