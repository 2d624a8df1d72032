"""Importance resampling of documents towards a target distribution.

Features are runs of 1 to ``max_n`` words, hashed into ``buckets``; a bucket's gain is the log ratio of its smoothed shares in the
target and in the corpus. Counts and gains are arrays with one place per bucket, whatever the number of rows, so documents are
scored by array look-ups in two passes without a shuffle. A draw without replacement is a top-k by score plus Gumbel noise; the k-th
composite key (score, id, row) is found by distributed quickselect: random pivots of the rows still in question, one exact count
of what is before, at and after each, and on with the interval that holds the k-th. Only the winners are sorted and ranked.

Defined cases: a null text has no words; documents without features have weight 0; equal scores go to the smaller id, null ids first,
then to the row read first; an empty corpus or target counts as no features. Equal rows are drawn by themselves (with the same
noise, for it comes from the id). Texts are read whole. Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlens.llm.words import distinct_slices, slices, text_spans
from trendlens.operators.ranking import with_position
from trendlens.session import settle

BUCKETS = 10_000
PIVOTS = 31  # pivots a round: the rows in question become about a thirtieth each time
# Fixed: what is no part of a word, once A-Z are lower-cased.
GAPS = np.zeros(256, bool)
GAPS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def feature_buckets(texts: pa.Array, max_n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, the bucket of every feature of all texts, and the first feature of each text (one more than texts)."""
    raw, starts, ends, first = text_spans(texts, lower=True, gaps=GAPS)
    codes, words = distinct_slices(raw, starts, ends)
    own = np.array([zlib.crc32(w) % buckets for w in words], np.int64)
    if max_n == 1:
        return np.diff(first), own[codes] if len(codes) else codes, first
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found, owner = [own[codes]] if len(codes) else [], [row]
    for n in range(2, max_n + 1):
        at = np.arange(max(0, len(codes) - n + 1))
        at = at[row[at] == row[at + n - 1]] if len(at) else at
        runs, which = np.unique(np.stack([codes[at + i] for i in range(n)], axis=1), axis=0, return_inverse=True)
        each = np.array([zlib.crc32(b" ".join([words[c] for c in run])) % buckets for run in runs.tolist()], np.int64)
        if len(at):
            found.append(each[which.ravel()])
            owner.append(row[at])
    flat, rows = np.concatenate([*found, np.zeros(0, np.int64)]), np.concatenate(owner)
    order = np.argsort(rows, kind="stable")
    return np.diff(first), flat[order], np.searchsorted(rows[order], np.arange(len(first)))


def bucket_counts(docs: DataFrame, max_n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: at most one row per task and bucket is shuffled, and the result has a fixed size."""
    def count(batches):
        sums = np.zeros(buckets, np.int64)
        for part in slices(batches):
            sums += np.bincount(feature_buckets(part.column(0), max_n, buckets)[1], minlength=buckets)
        hit = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"bucket": hit.astype(np.int32), "n": sums[hit]})

    total = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[total["bucket"].to_numpy()] = total["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, floored."""
    n = len(corpus)
    up = (target + 1).astype(float) * float(corpus.sum() + n)
    return np.floor(1000.0 * np.log(up / ((corpus + 1).astype(float) * float(target.sum() + n)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, max_n: int = 1, key: str = "doc_id") -> DataFrame:
    """(key, text) to key, n_words, n_features, weight: the floored mean gain of the features, repeats counted."""
    def score(batches):
        for part in slices(batches):
            words, hit, first = feature_buckets(part.column(1), max_n, len(gain))
            total = np.concatenate([[0], np.cumsum(gain[hit])]).astype(np.int64)
            n = np.diff(first)
            sums = total[first[1:]] - total[first[:-1]]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)),
                                              pa.array(np.where(n > 0, sums // np.maximum(n, 1), 0))],
                                             names=["key", "n_words", "n_features", "weight"])

    kind = docs.select(F.col(key).alias("key"), *[F.lit(0).cast("long").alias(c) for c in ("n_words", "n_features", "weight")]).schema
    return docs.select(key, "text").mapInArrow(score, kind)


def gumbel(key: str, seed: int):
    """Floored thousandths of Gumbel noise, from the first 32 bits of SHA-256 of ``seed:key``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def kth(rows: DataFrame, order: list[str], k: int, pivots: int = PIVOTS, seed: int = 0) -> tuple | None:
    """The k-th least composite key of ``rows``; keys are to be unique. None if there are not so many rows.

    Each round takes random pivots among the rows in question and counts, in one exact pass, what is before and at each.
    """
    name = [f"k{i}" for i in range(len(order))]
    left = rows.select(*[F.col(c).alias(n) for c, n in zip(order, name)])
    place = F.struct(*name)

    def literal(value: tuple):
        return F.struct(*[F.lit(v).cast(left.schema[n].dataType).alias(n) for n, v in zip(name, value)])

    low, high, before, turn = None, None, 0, seed
    while True:
        here = left
        if low is not None:
            here = here.where(place > literal(low))
        if high is not None:
            here = here.where(place < literal(high))
        picked = here.orderBy(F.xxhash64(*name, F.lit(turn)), *name).limit(pivots).collect()
        if not picked:
            return None
        tried = sorted((tuple(r) for r in picked), key=lambda t: tuple((v is not None, v) for v in t))
        sums = here.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(place < literal(p), 1)).alias(f"less{i}") for i, p in enumerate(tried)],
                        *[F.count(F.when(place == literal(p), 1)).alias(f"same{i}") for i, p in enumerate(tried)]).first()
        if k > before + sums["n"]:
            return None
        more = 0
        for i, p in enumerate(tried):
            if k <= before + sums[f"less{i}"]:
                high = p
                break
            if k <= before + sums[f"less{i}"] + sums[f"same{i}"]:
                return p
            low, more = p, sums[f"less{i}"] + sums[f"same{i}"]
        before, turn = before + more, turn + 1


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, seed: int = 2024, max_n: int = 1,
             buckets: int = BUCKETS, key: str = "doc_id") -> DataFrame:
    """All documents with weight, score and the rank of those drawn: ``percent`` of the ones with at least ``min_words`` words."""
    gain = gains(bucket_counts(docs, max_n, buckets), bucket_counts(target, max_n, buckets))
    scored = settle(weighed(docs, gain, max_n, key).select(
        "key", "n_words", "n_features", "weight", (F.col("weight") + gumbel("key", seed)).alias("score"),
        F.monotonically_increasing_id().alias("row")).withColumn("down", -F.col("score")))
    able = F.col("n_words") >= min_words
    order = ["down", "key", "row"]
    k = scored.where(able).count() * percent // 100
    last = kth(scored.where(able), order, k) if k else None
    columns = ["key", "n_features", "weight", "score"]
    if last is None:
        done = scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    else:
        edge = F.struct(*[F.lit(v).cast(scored.schema[c].dataType).alias(c) for c, v in zip(order, last)])
        drawn = able & (F.struct(*order) <= edge)
        ranked = with_position(scored.where(drawn).select(*columns, "down", "row"), order, "place")
        done = ranked.select(*columns, (F.col("place") + 1).alias("rank")).unionByName(
            scored.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))
    return done.withColumnRenamed("key", key)


def op13_resample(spark, sf_dir: str) -> DataFrame:
    """Draw a tenth of the documents, weighed by how much their words are like those of the benchmark texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resample(docs, target)


ORACLE_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), goal AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), each AS (
  SELECT r, unnest(words) AS word FROM docs
), bucket AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(word)),
      lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS b
  FROM (SELECT DISTINCT word FROM (SELECT word FROM each UNION ALL SELECT word FROM goal)), crc
), corpus AS (
  SELECT b, count(*) AS s FROM each JOIN bucket USING (word) GROUP BY b
), target AS (
  SELECT b, count(*) AS t FROM goal JOIN bucket USING (word) GROUP BY b
), gain AS (
  SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM corpus) + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM target) + 10000)::DOUBLE)))::BIGINT AS g FROM corpus LEFT JOIN target USING (b)
), sums AS (
  SELECT r, sum(g)::BIGINT AS g FROM each JOIN bucket USING (word) JOIN gain USING (b) GROUP BY r
), weights AS (
  SELECT r, doc_id, len(words)::BIGINT AS n_features, coalesce(floor(g::DOUBLE / len(words))::BIGINT, 0) AS weight,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM docs LEFT JOIN sums USING (r)
), scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weights
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, r) AS place FROM scored
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= 20 AND place <= (SELECT count(*) * 10 // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank
FROM ranked
"""
