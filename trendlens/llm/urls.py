"""URL filter: host and path rules decide where one fits, boosted trees on lexical features elsewhere.

The trees learn from the URLs that rules label. Features: lengths, depth, digit ratio, character entropy, parameter
counts, hyphens, and statistics of host suffixes (how often a suffix occurs, how often it is blocked among the
labelled URLs), all column expressions over all rows. A labelled URL's own fifth of the URLs is left out of the block shares that
it is trained with, so no row is told its own label. The trees are fitted on at most ``max_train`` distinct labelled URLs, half
of them at most from each verdict, those with the smallest hash, weighed by how many rows they stand for; every
other figure covers all rows.

Defined cases: a null URL, or one without ``://``, has empty host and path and is judged by the trees like any
other; without labelled rows of both kinds the only known verdict, else ``allow``, is given; repeated rows get equal
verdicts; an empty table gives no rows; columns beyond the keys and the URL are not read, so they may have any name.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendlens.session import attach_small, settle

Rule = tuple[str, str, str]  # verdict, host, path

RULES: tuple[Rule, ...] = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
FEATURES = ["url_len", "host_len", "path_len", "depth", "labels", "digits", "entropy", "params", "hyphens", "fragment",
            "suffix_share", "suffix_block", "domain_share", "domain_block"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``, A-Z lower-cased. Path: from there up to ``? #``."""
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule whose host is the URL's or a parent of it and whose path begins the URL's: rule, verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits per character of an array of one-character strings."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    sorted_chars = F.array_sort(chars)
    runs = F.aggregate(
        sorted_chars,
        F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")),
        lambda s, c: F.struct(
            c.alias("last"), F.when(c == s["last"], s["run"] + 1.0).otherwise(F.lit(1.0)).alias("run"),
            F.when(c == s["last"], s["sum"]).otherwise(
                s["sum"] + F.when(s["run"] > 0, s["run"] * F.log2(s["run"])).otherwise(0.0)).alias("sum")),
        lambda s: s["sum"] + F.when(s["run"] > 0, s["run"] * F.log2(s["run"])).otherwise(0.0))
    return F.when(n > 0, F.log2(n.cast("double")) - runs / n).otherwise(0.0)


def lexical_features(rows: DataFrame) -> DataFrame:
    """Add the features that one URL has by itself; expects url, host, path."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    count = lambda text, chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("double")
    length = F.length(url).cast("double")
    return rows.withColumns({
        "url_len": length, "host_len": F.length("host").cast("double"), "path_len": F.length("path").cast("double"),
        "depth": count(F.col("path"), "/"), "labels": count(F.col("host"), "."),
        "digits": F.when(length > 0, count(url, "0123456789") / length).otherwise(0.0), "entropy": _entropy(url),
        "params": F.when(query == "", 0.0).otherwise(count(query, "&") + 1.0), "hyphens": count(F.col("host"), "-"),
        "fragment": F.contains(url, F.lit("#")).cast("double"),
        "suffix": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2),
    })


FOLDS = 5


def suffix_statistics(rows: DataFrame, column: str) -> DataFrame:
    """Per value of ``column``: its rows, and by fold its labelled rows and the blocked ones among them."""
    def folds(hit: Column) -> Column:
        return F.array(*[F.count(F.when((F.col("fold") == f) & hit, 1)) for f in range(FOLDS)])

    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"), folds(F.col("known") == "block").alias("blocked"),
                                    folds(F.col("known").isNotNull()).alias("labelled"))


def with_suffix_features(rows: DataFrame) -> DataFrame:
    """Add how frequent the suffix and the domain are (log), and their smoothed block shares, without a labelled row's own fold."""
    for column in ("suffix", "domain"):
        rows = attach_small(rows, settle(suffix_statistics(rows, column)), [column])

        def others(counts: str) -> Column:
            whole = F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b)
            return whole - F.when(F.col("known").isNotNull(), F.get(counts, F.col("fold"))).otherwise(0)

        rows = rows.withColumns({
            f"{column}_share": F.log1p(F.col("n").cast("double")),
            f"{column}_block": (others("blocked") + 1.0) / (others("labelled") + 2.0)}).drop("n", "blocked", "labelled")
    return rows


def featured(pages: DataFrame, keys: list[str], rules=RULES) -> DataFrame:
    """Keys (as key0, key1, …), url, host, path, rule, known (its verdict), fold and the vector of features."""
    host, path = host_and_path(F.col("url"))
    named = pages.select(*[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)], "url").withColumns({"host": host, "path": path})
    rule, known = rule_of(F.col("host"), F.col("path"), rules)
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")
    rows = settle(lexical_features(named.withColumns({"rule": rule, "known": known, "fold": fold})))
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_suffix_features(rows))


def fit(labelled: DataFrame, max_train: int, trees: int, depth: int) -> GBTClassificationModel | None:
    """Trees from at most ``max_train`` distinct URLs of ``labelled`` rows; None without both verdicts."""
    urls = settle(labelled.groupBy("url").agg(F.any_value("known").alias("known"), F.any_value("features").alias("features"),
                                              F.count(F.lit(1)).cast("double").alias("n")))
    totals = {r["known"]: r["n"] for r in urls.groupBy("known").agg(F.sum("n").alias("n")).collect()}
    if len(totals) < 2:
        return None
    parts = []
    for kind in ("allow", "block"):
        some = settle(urls.where(F.col("known") == kind).orderBy(F.xxhash64("url"), "url").limit(max_train // 2))
        scale = totals[kind] / some.agg(F.sum("n")).first()[0]
        parts.append(some.select("features", F.lit(float(kind == "block")).alias("label"), (F.col("n") * scale).alias("w")))
    return GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, seed=17, stepSize=0.3, weightCol="w").fit(
        settle(parts[0].union(parts[1])))


def judge(pages: DataFrame, keys: list[str] | None = None, rules=RULES, max_train: int = 20_000, trees: int = 8, depth: int = 3) -> DataFrame:
    """(keys, url) to keys, url, host, path, rule, verdict and block_score (null where a rule decides)."""
    keys = ["page_id"] if keys is None else keys
    rows = settle(featured(pages, keys, rules))
    labelled = rows.where("known is not null")
    model = fit(labelled, max_train, trees, depth)
    if model is None:
        only = labelled.select("known").head()
        judged = rows.withColumns({"verdict": F.coalesce("known", F.lit(only[0] if only else "allow")),
                                   "block_score": F.lit(None).cast("double")})
    else:
        judged = model.transform(rows).withColumns({
            "verdict": F.coalesce("known", F.when(F.col("prediction") > 0.5, "block").otherwise("allow")),
            "block_score": F.when(F.col("known").isNull(), vector_to_array("probability")[1])})
    return judged.select(*[F.col(f"key{i}").alias(k) for i, k in enumerate(keys)], "url", "host", "path", "rule", "verdict", "block_score")


def held_out_auc(pages: DataFrame, fold: int = 0, rules=RULES, max_train: int = 20_000, trees: int = 8, depth: int = 3) -> float | None:
    """Area under the ROC curve on the labelled URLs of one fold, by trees that learnt from the others."""
    rows = settle(featured(pages, [], rules).where("known is not null"))
    model = fit(rows.where(F.col("fold") != fold), max_train, trees, depth)
    told = rows.where(F.col("fold") == fold)
    if model is None or told.groupBy("known").count().count() < 2:
        return None
    scored = model.transform(told.withColumn("label", (F.col("known") == "block").cast("double")))
    return BinaryClassificationEvaluator().evaluate(scored)


def op8_urls(spark, sf_dir: str) -> DataFrame:
    """Judge every page's URL."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "block_score")


ORACLE_SQL = None  # the trees are no SQL; rules and fields are tested against brute force
