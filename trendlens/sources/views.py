"""The given tables in the shape of the library's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlens.functions import fixed
from trendlens.session import spread

# A row of the videos view is identified by all of these together.
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]

REGION_CODES = {"AFRICA": "AFR", "AMERICA": "AME", "ASIA": "ASI", "EUROPE": "EUR", "MIDDLE EAST": "RUS"}
EVENT_DAYS = {"summer": ("1996-07-20", "1996-08-04"), "winter": ("1998-02-07", "1998-02-22")}
CORPUS_TERMS = ["ción", "ñ", "lich", "çou", "ère", "license"]


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet").select(*(columns or "*"))


def _placed(rows: DataFrame, spark: SparkSession, sf: str, custkey: str) -> DataFrame:
    """Rows with nation and region of their customer; sizes decide the strategies."""
    return rows.join(places(spark, sf), F.col(custkey) == F.col("c_custkey"))


def places(spark: SparkSession, sf: str) -> DataFrame:
    """Customer to country."""
    nation = table(spark, sf, "nation")
    return (
        table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "r_name", "n_name")
    )


def videos(spark: SparkSession, sf: str, country: str = "r_name") -> DataFrame:
    """Labelled trending records: one per line item.

    Orders get their place first, so the line items, the big side, are shuffled once. Orders are hashed there, and no line item is sorted.
    """
    items = spread(table(spark, sf, "lineitem", *ORDER, "l_returnflag"))
    orders = _placed(table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate"), spark, sf, "o_custkey")
    rows = items.join(orders.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
    label = F.when(F.col("l_returnflag") == "R", "olympic").when(F.col("l_returnflag") == "A", "other_sport")
    return rows.select(
        F.col("l_partkey").alias("video_id"), F.col(country).alias("country_code"),
        F.col("o_orderdate").alias("publishedAt"), F.col("l_shipdate").alias("trending_date"),
        label.otherwise("non_sport").alias("predicted_label"), *ORDER,
    )


def medals(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Medal rows per event: urgent orders of the event's days."""
    code = F.when(F.col("r_name") == "MIDDLE EAST", "ROC").otherwise(F.upper(F.substring("r_name", 1, 3)))
    orders = table(spark, sf, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"))
    out = {}
    for event, (first, last) in EVENT_DAYS.items():
        held = orders.filter(
            (F.col("o_orderdate") >= F.lit(first).cast("timestamp_ntz"))
            & (F.col("o_orderdate") < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz"))
        )
        out[event] = _placed(held, spark, sf, "o_custkey").select(
            F.col("o_orderdate").cast("date").alias("date_clean"), code.alias("country_code"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("medal_code"),
        )
    return out


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as unlabelled records."""
    return spread(table(spark, sf, "documents", "doc_id", "text", "lang", "source")).select(
        "doc_id",
        F.col("doc_id").cast("string").alias("video_id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.lit("").alias("tags"),
        F.col("text").alias("description"),
        F.col("source").alias("channelTitle"),
        F.lit(None).cast("string").alias("publish_time"),
        F.col("lang").alias("country_code"),
    )


def train(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents; toxic ones play the rare class."""
    label = F.when(F.col("toxic") == 1, "olympic").when(F.col("quality") == 1, "other_sport").otherwise("non_sport")
    labels = table(spark, sf, "labels").select("doc_id", label.alias("label"))
    return corpus(spark, sf).join(labels, "doc_id")


def known_parts(spark: SparkSession, sf: str) -> DataFrame:
    """All records, as the lookup table of countries is made from."""
    return videos(spark, sf)


def candidate_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as candidates; every fifth has a key that no record has."""
    key = F.when(F.col("p_partkey") % 5 == 0, -F.col("p_partkey")).otherwise(F.col("p_partkey"))
    return table(spark, sf, "part").select(key.alias("video_id"), "p_name")


# Each listed term in capitals, with a capital at the front, and as it is. Spelt here, for engines differ in the capitals of some letters.
SPELLINGS = [x for t in dict.fromkeys(fixed.GAMES_STEMS + fixed.SPORT_TERMS) for x in (t.upper(), t[:1].upper() + t[1:], t)]


def termed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, half of them with one term of the fixed lists in front, each term in three spellings of case."""
    at = F.floor(F.col("doc_id") / 2) % (len(SPELLINGS) // 3) * 3 + F.col("doc_id") % 3
    spelt = F.get(F.array(*[F.lit(t) for t in SPELLINGS]), at.cast("int"))
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x"), spelt, F.lit("x "), F.col("text"))).otherwise(F.col("text"))
    return spread(table(spark, sf, "documents", "doc_id", "text", "lang")).select("doc_id", "lang", text.alias("text"))


def dirty_train(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as people label: each row up to three times (``copy``), with blanks around keys, labels in any case.

    The key is the language, the whole title and the source, so documents that begin alike are copies as well.
    """
    rows = train(spark, sf).withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))))
    blank = F.when(F.col("copy") == 0, "").when(F.col("copy") == 1, " ").otherwise("\t")
    return rows.withColumns({
        "video_id": F.concat(F.lit(" "), "country_code", blank), "title": F.concat("title", blank), "tags": F.concat(blank, "channelTitle"),
        "label": F.when(F.col("copy") == 0, F.upper("label")).when(F.col("copy") == 1, F.concat(F.lit(" "), F.initcap("label"), F.lit("\n")))
        .otherwise(F.col("label"))})


def _said(spark: SparkSession, sf: str) -> DataFrame:
    label = F.element_at(F.array(F.lit("olympic"), F.lit("other_sport"), F.lit("non_sport")),
                         (F.col("doc_id") % 3 + 1).cast("int"))
    reason = F.regexp_replace("text", r"[^\p{L}\p{N} ]", " ")
    documents = spread(table(spark, sf, "documents", "doc_id", "text"))
    return documents.select("doc_id", label.alias("l"), reason.alias("r"))


def _shaped(said: DataFrame, shapes: list[str]) -> DataFrame:
    """Text by shape number; ``@L`` and ``@R`` stand for label and reason."""
    raw = None
    for i, shape in enumerate(shapes):
        text = F.replace(F.replace(F.lit(shape), F.lit("@L"), F.col("l")), F.lit("@R"), F.col("r"))
        hit = F.col("doc_id") % len(shapes) == i
        raw = F.when(hit, text) if raw is None else raw.when(hit, text)
    return said.select("doc_id", raw.alias("raw_resp"))


JSON_SHAPES = [
    '{"label":"@L","reason":"@R"}',
    'Sure. {"label": "@L", "reason": "@R"} Done.',
    '{"label":"@L","reason":"@R',
    "{'label':'@L','reason':'@R'}",
    '{"label":"@L","reason":5}',
    " \n ",
    '{"reason":"@R","label":"medal"}',
    '{"label":"@L","reason":"@R"',
    '{"label":"@L" "reason":" ,;"}',
    '{"label":"@L","reason":"@R"} and {"label":"olympic"}',
]
LINE_SHAPES = [
    "Label: @L\nReason: @R",
    "LABEL:   @L extra\n reason:@R ",
    "Label: medal\nReason: @R",
    "Label: olympic\nReason: first\nLabel: @L\nReason: @R\nLabel: unsure",
    "Label:\nReason: @R",
    "@R",
]


def json_answers(spark: SparkSession, sf: str) -> DataFrame:
    return _shaped(_said(spark, sf), JSON_SHAPES)


def line_answers(spark: SparkSession, sf: str) -> DataFrame:
    return _shaped(_said(spark, sf), LINE_SHAPES)
