import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trendlens.functions import fixed, text, values


def one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} string" for n in names))
    return df.select(expr).first()[0]


def hits(spark, texts, terms):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(text.has_keyword(F.col("t"), terms)).collect()]


def test_case_folding_in_every_script(spark):
    texts = ["ОЛИМП 2020", "FÚTBOL", "fútbol", "क्रिकेट आज", "スキンケア サッカー", "skin care", "nothing", "FUSSBALL", "축구"]
    assert hits(spark, texts, fixed.SPORT_TERMS) == [True, True, True, True, True, True, False, False, True]


def test_keyword_pattern_is_the_plain_alternation(spark):
    plain = re.compile("|".join(re.escape(t) for t in fixed.SPORT_TERMS), re.I)
    words = [t[:-1] for t in fixed.SPORT_TERMS] + [t.upper() for t in fixed.SPORT_TERMS] + [
        f"x{t}y" for t in fixed.GAMES_STEMS] + ["ſki", "oKayak", "oLİMPi", "sw im", "trac.k", "Kanoe canoe"]
    assert hits(spark, words, fixed.SPORT_TERMS) == [bool(plain.search(w)) for w in words]


def test_keyword_terms_are_literal(spark):
    assert hits(spark, ["a.b", "axb", "c+d", "(e"], ["a.b", "c+d", "(e"]) == [True, False, True, True]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab.ñÑé", min_size=1, max_size=4), min_size=1, max_size=6),
       st.lists(st.text("aAbB.ñÑéÉ ", max_size=8), min_size=1, max_size=8))
def test_keyword_property(spark, terms, texts):
    plain = re.compile("|".join(re.escape(t) for t in terms), re.I)
    assert hits(spark, texts, terms) == [bool(plain.search(t)) for t in texts]


def test_no_terms():
    with pytest.raises(ValueError):
        text.keyword_pattern([])


def test_joined_text_keeps_separators(spark):
    assert one(spark, text.joined_text(["a", "b", "c"]), a="x", b=None, c="z") == "x  z"


def test_strip_is_the_unicode_strip(spark):
    raw = "　\x1f  a b \n\x85"
    assert one(spark, text.strip(F.col("a")), a=raw) == raw.strip() == "a b"
    assert one(spark, text.normalise_label("a"), a="\tOlympic  ") == "olympic"


def test_signature_nulls_are_empty(spark):
    want = hashlib.sha1("t||".encode()).hexdigest()
    assert one(spark, text.signature(), title="t", channelTitle=None, publish_time=None) == want


def test_record_key(spark):
    assert one(spark, text.record_key(), video_id=" v ", title=None, tags="x\n") == "v||||x"


def test_tokens_and_ngrams(spark):
    words = text.tokens(F.col("a"))
    assert one(spark, words, a="El MARATÓN a_1 x दौड़") == ["el", "maratón", "a_1"]
    assert one(spark, text.ngrams(words, 2), a="aa bb cc") == ["aa bb", "bb cc"]
    assert one(spark, text.ngrams(words, 3), a="aa bb") == []


def test_one_line_and_clip(spark):
    assert one(spark, text.one_line("a"), a="x\ny\r\n") == "x y\r "
    assert one(spark, text.clip("a", 3), a="añ😀bc") == "añ😀"


def test_flags_on_every_label(spark):
    df = spark.createDataFrame([(x,) for x in [None, "", *fixed.LABELS]], "predicted_label string")
    got = [tuple(r) for r in df.select(values.sport_flag(), values.olympic_flag()).collect()]
    assert got == [(1, 0), (1, 0), (1, 1), (1, 0), (0, 0)]


def test_country_maps(spark):
    assert one(spark, values.mapped("c", fixed.COMMITTEE_CODES), c="DE") == "GER"
    assert one(spark, values.mapped("c", fixed.COMMITTEE_CODES), c="ZZ") is None
    assert one(spark, values.replaced("c", fixed.CODE_ALIASES), c="ROC") == "RUS"
    assert one(spark, values.replaced("c", fixed.CODE_ALIASES), c="JPN") == "JPN"
    assert one(spark, values.country_or("c"), c="") == ""
    assert one(spark, values.country_or("c", empty_too=True), c="") == "XX"


def test_day_drops_the_zone(spark):
    texts = ["2020-08-11T16:34:06Z", "2020-08-12T01:30:00+09:00", "2020-08-12", "2020-08-12 23:59:59"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [str(r[0]) for r in df.select(values.day(df, "t")).collect()]
    assert got == ["2020-08-11", "2020-08-12", "2020-08-12", "2020-08-12"]


def test_bad_day_is_an_error(spark):
    df = spark.createDataFrame([("soon",)], "t string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(values.day(df, "t")).collect()
