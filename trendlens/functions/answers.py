"""Labeller answers to (label, reason): line format and JSON format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendlens.functions import fixed
from trendlens.functions.text import SPACE_CHARS, strip
from trendlens.functions.values import valid_label

_STRICT = {"allowSingleQuotes": "false"}
_FIELDS = "struct<label:variant,reason:variant>"


def _last_value(lines: Column, name: str, pick) -> Column:
    """``pick`` applied to what follows ``name:`` in each line that starts so; the last non-null."""
    found = F.filter(lines, lambda l: F.lower(F.substring(l, 1, len(name) + 1)) == name + ":")
    values = F.transform(found, lambda l: pick(strip(F.substring(l, len(name) + 2, 2**31 - 1))))
    return F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(-1))


def with_line_answer(df: DataFrame, raw: str) -> DataFrame:
    """Add label and reason from ``Label: …`` / ``Reason: …`` lines.

    The last line with a valid label wins, invalid and empty ones are passed
    over; the last reason line wins even if empty.
    """
    text = F.coalesce(F.col(raw), F.lit(""))
    lines = F.col("_lines")

    def first_word(value: Column) -> Column:
        word = F.lower(F.split_part(F.translate(value, SPACE_CHARS, " " * len(SPACE_CHARS)), F.lit(" "), F.lit(1)))
        return F.when(word.isin(fixed.LABELS), word)

    return (
        df.withColumn("_lines", F.transform(F.split(strip(text), "\n"), strip))
        .withColumns({
            "label": F.coalesce(_last_value(lines, "label", first_word), F.lit(fixed.DEFAULT_LABEL)),
            "reason": F.coalesce(_last_value(lines, "reason", lambda v: v), F.lit("")),
        })
        .drop("_lines")
    )


def json_block(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; the whole text if there is no such block."""
    block = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(block == "", text).otherwise(block)


def _occurrences(text: Column, ch: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


def repair_braces(text: Column) -> Column:
    lack = F.greatest(_occurrences(text, "{") - _occurrences(text, "}"), F.lit(0))
    return F.concat(text, F.repeat(F.lit("}"), lack))


def repair_quote(text: Column) -> Column:
    return F.when(_occurrences(text, '"') % 2 == 1, F.concat(text, F.lit('"'))).otherwise(text)


def repair_end(text: Column) -> Column:
    """A closing brace for balanced text with a quote that does not end in one."""
    short = (
        F.contains(text, F.lit('"'))
        & ~F.endswith(strip(text), F.lit("}"))
        & (_occurrences(text, "{") == _occurrences(text, "}"))
    )
    return F.when(short, F.concat(text, F.lit("}"))).otherwise(text)


def _read_objects(text: Column) -> Column:
    """The text read inside ``[…]`` and inside ``{"v":…}``.

    The JSON reader stops after the first value; trailing junk cannot close
    both brackets, so only exactly one object passes both. Fields come as
    variants, so a number is not taken for a text.
    """
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{_FIELDS}>", _STRICT)
    nested = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), f"struct<v:{_FIELDS}>", _STRICT)
    return F.struct(listed.alias("listed"), nested["v"].alias("one"))


def _checked(objects: str) -> Column:
    """struct(label, reason) if the label is known and the reason a text, else null."""
    listed, one = F.col(f"{objects}.listed"), F.col(f"{objects}.one")
    label = F.try_variant_get(one["label"], "$", "string")
    good = (
        (F.size(listed) == 1)
        & (F.schema_of_variant(one["label"]) == "STRING")
        & (F.schema_of_variant(one["reason"]) == "STRING")
        & (F.schema_of_variant(F.get(listed, F.lit(0))["reason"]) == "STRING")
        & label.isin(fixed.LABELS)
    )
    reason = F.try_variant_get(one["reason"], "$", "string")
    return F.when(good, F.struct(label.alias("label"), reason.alias("reason")))


def _searched(block: Column) -> Column:
    """struct(label, reason) by text search, for what is no valid object."""
    found = F.rtrim(strip(F.regexp_extract(block, fixed.REASON_PATTERN, 1)), F.lit(" ,;:"))
    return F.struct(
        valid_label(F.lower(F.regexp_extract(block, fixed.LABEL_PATTERN, 1))).alias("label"),
        F.when(~block.rlike(fixed.REASON_PATTERN), fixed.UNPARSED_REASON)
        .when(found == "", fixed.TRUNCATED_REASON)
        .otherwise(found)
        .alias("reason"),
    )


def with_json_answer(df: DataFrame, raw: str, quote_first: bool = False) -> DataFrame:
    """Add label and reason: valid JSON, repaired JSON, then text search.

    One column per step, each step only for rows the one before left open.
    """
    blank = F.struct(F.lit(fixed.DEFAULT_LABEL).alias("label"), F.lit(fixed.EMPTY_REASON).alias("reason"))
    block, answer, fixed_up = F.col("_block"), F.col("_answer"), F.col("_repaired")
    return (
        df.withColumn("_text", strip(F.coalesce(F.col(raw), F.lit(""))))
        .withColumn("_block", json_block(F.col("_text")))
        .withColumn("_objects", _read_objects(block))
        .withColumn("_answer", F.when(F.col("_text") == "", blank).otherwise(_checked("_objects")))
        .withColumn("_repaired", F.when(answer.isNull(), repair_quote(repair_braces(block)) if not quote_first
                                        else repair_braces(repair_quote(block))))
        .withColumn("_repaired", fixed_up if quote_first else repair_end(fixed_up))
        .withColumn("_objects", _read_objects(fixed_up))
        .withColumn("_answer", F.coalesce(answer, _checked("_objects"), _searched(block)))
        .withColumns({"label": F.col("_answer.label"), "reason": F.col("_answer.reason")})
        .drop("_text", "_block", "_objects", "_answer", "_repaired")
    )
