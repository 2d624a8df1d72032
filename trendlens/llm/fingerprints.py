"""SimHash fingerprints of documents and their search by permuted block tables.

Terms are runs of ``shingle`` words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; a text with fewer words is one term). Each
occurrence of a term adds the signed bits of its hash to the votes, so a term weighs as much as it is frequent; the
signs of the votes are the fingerprint. Texts without words have the fingerprint zero.

Defined cases: a null text is the empty text; equal texts have equal fingerprints; repeated rows are documents of their
own; an empty table gives no rows; further columns are ignored. In the order of documents, ties of doc_id go by text,
and a null doc_id comes after all others. A single document is its own next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trendlens.llm.words import mix, slices, text_words, window_hashes
from trendlens.session import settle

BITS = 128
RADIUS, BLOCKS, FLIPS = 16, 6, 2  # of op10: six tables of 21 or 22 bits, of which up to two may differ


def simhash(texts: pa.Array, shingle: int = 3) -> np.ndarray:
    """Fingerprints as an array (texts, 2) of unsigned 64-bit integers."""
    _, _, _, first, words = text_words(texts, lower=True)
    words = words[:, 0]
    count = np.diff(first)
    out = np.zeros((len(count), BITS // 64), np.uint64)
    terms = np.maximum(np.where(count > 0, count - shingle + 1, 0), (count > 0).astype(np.int64))
    edge = np.concatenate([[0], np.cumsum(terms)])
    if not edge[-1]:
        return out
    hashes = np.zeros(edge[-1], np.uint64)
    rolled, long_enough = window_hashes(words, shingle), np.repeat(count >= shingle, terms)
    at = np.repeat(first[:-1] - edge[:-1], terms) + np.arange(edge[-1])
    hashes[long_enough] = rolled[at[long_enough]]
    for row in np.flatnonzero((count > 0) & (count < shingle)):
        hashes[edge[row]] = window_hashes(words[first[row]: first[row + 1]], int(count[row]))[0]
    # Votes: eight one-byte counters in a word, at most 255 terms of one text at a time.
    begin = edge[:-1][terms > 0]
    chunks = np.unique(np.concatenate([begin, *(np.arange(a, b, 255) for a, b in zip(begin, edge[1:][terms > 0]) if b - a > 255)]))
    owner = np.searchsorted(chunks, begin)
    for lane in range(BITS // 64):
        h = mix(hashes + np.uint64((0x9E3779B97F4A7C15 * (lane + 1)) & 0xFFFFFFFFFFFFFFFF))
        for j in range(8):
            sums = np.add.reduceat((h >> np.uint64(j)) & np.uint64(0x0101010101010101), chunks)
            ones = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), owner, axis=0)
            signs = 2 * ones > terms[terms > 0][:, None]
            word = (signs.astype(np.uint64) << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(axis=1, dtype=np.uint64)
            out[terms > 0, lane] |= word << np.uint64(j)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1.0 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def as_hex(prints: np.ndarray) -> list[str]:
    return [f"{a:016x}{b:016x}" for a, b in prints.tolist()]


def next_to_each_other(docs: DataFrame) -> DataFrame:
    """(doc_id, text) dealt so that each partition's rows (block, extra, doc_id, text), in order, have their next one.

    Blocks are ranges of doc_id whose ends are doc_ids of the table (its quantiles). The first row of a block, in
    descending order, also goes to the block before it as ``extra``; the first of all to the last block.
    """
    spark = docs.sparkSession
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / blocks for i in range(1, blocks)]
    found = keyed.agg(F.percentile_approx("doc_id", F.array(*[F.lit(x) for x in [0.5, *shares]]), 10 * blocks).alias("q"),
                      F.max("doc_id").alias("top")).first()
    ends = np.array(sorted({*(found["q"] or []), *([] if found["top"] is None else [found["top"]])}), np.int64)

    @F.pandas_udf("array<int>")
    def blocks_of(ids):
        import pandas as pd

        block = np.searchsorted(ends, ids.to_numpy())
        head = ends[block] == ids.to_numpy()
        after = np.where(block + 1 < len(ends), block + 1, 0)
        return pd.Series([[b, a] if h else [b] for b, a, h in zip(block.tolist(), after.tolist(), head.tolist())])

    dealt = keyed.select("doc_id", "text", F.posexplode(blocks_of("doc_id")).alias("extra", "block"))
    return dealt.repartition(blocks, "block").sortWithinPartitions("block", "extra", F.desc("doc_id"), "text")


def edit_and_print(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to each other and to the next document's."""
    kind = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double")

    def run(batches):
        held: list[dict] = []
        for part in slices(batches):
            rows = held + part.to_pylist()
            held = rows[-1:]
            own = rows[:-1]
            use = [i for i, r in enumerate(own) if not r["extra"] and rows[i + 1]["block"] == r["block"]]
            if not use:
                continue
            edited = []
            for i in use:
                text, other = rows[i]["text"], rows[i + 1]["text"]
                half = len(text) // 2
                edited.append(text[: len(text) - half] + other[:half])
            prints = simhash(pa.array([r["text"] for r in rows], pa.large_string()), shingle)
            after = simhash(pa.array(edited, pa.large_string()), shingle)
            mine, following = prints[use], prints[np.array(use) + 1]
            yield pa.RecordBatch.from_pydict({
                "doc_id": [None if own[i]["doc_id"] == -(1 << 63) else own[i]["doc_id"] for i in use],
                "n_chars": [len(own[i]["text"]) for i in use],
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                "fingerprint": as_hex(mine), "edited_fingerprint": as_hex(after),
                "near_edited": likeness(mine, after), "near_next": likeness(mine, following)}, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(StructType.fromDDL(kind))
    return next_to_each_other(docs).mapInArrow(run, kind)


def _bits(positions: Iterable[int]) -> tuple[int, int]:
    """The two 64-bit lanes of a fingerprint in which only these bits are set."""
    value = sum(1 << (BITS - 1 - b) for b in positions)
    return value >> 64, value & 0xFFFFFFFFFFFFFFFF


def _flips(block: range, flips: int) -> list[tuple[int, int]]:
    return [_bits(c) for k in range(flips + 1) for c in combinations(block, k)]


def within_radius(prints: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 4, flips: int = 0) -> DataFrame:
    """All pairs (query, found, distance) of distinct fingerprints within ``radius`` bits.

    The bits are cut into ``blocks`` blocks. A block that differs in more than ``flips`` bits uses up flips + 1 bits of the
    radius, so of fingerprints within it at least blocks - radius // (flips + 1) blocks differ in no more. There is one table
    per choice of that many blocks, keyed by their bits; it is asked for the query's bits and for all that come from
    turning over up to ``flips`` bits in each of its blocks. So every pair is found; a pair is taken in its first table.
    Both inputs have a column ``fingerprint``; a null one is found by nothing.
    """
    agree = blocks - radius // (flips + 1)
    if agree < 1:
        raise ValueError("needs more blocks than bits in the radius, or more flips")
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    spans = [range(a, b) for a, b in zip(cuts[:-1], cuts[1:])]
    tables = list(combinations(range(blocks), agree))

    def keyed(rows: DataFrame, name: str, probes: int) -> DataFrame:
        def run(batches):
            masks = [np.array(_bits(b for k in table for b in spans[k]), np.uint64) for table in tables]
            turned = [np.bitwise_xor.reduce(np.array(list(product(*[_flips(spans[k], probes) for k in table])), np.uint64), axis=1)
                      for table in tables]
            earlier = [sum(1 << k for k in range(table[-1]) if k not in table) for table in tables]
            for batch in batches:
                lanes = np.array([_lanes(f) for f in batch.column(0).to_pylist()], np.uint64).reshape(-1, 2)
                for n, (mask, turn) in enumerate(zip(masks, turned)):
                    step = max(1, 100_000 // len(turn))
                    for at in range(0, len(lanes), step):
                        some = lanes[at: at + step]
                        keys = ((some & mask)[:, None, :] ^ turn[None]).reshape(-1, 2).view(np.int64)
                        own = np.repeat(some, len(turn), axis=0).view(np.int64)
                        yield pa.RecordBatch.from_pydict({
                            f"{name}_table": pa.array(np.full(len(keys), n, np.int32)), f"{name}_earlier": pa.array(np.full(len(keys), earlier[n])),
                            f"{name}_k0": keys[:, 0].copy(), f"{name}_k1": keys[:, 1].copy(), f"{name}_0": own[:, 0].copy(), f"{name}_1": own[:, 1].copy()})

        kind = f"{name}_table int, {name}_earlier long, {name}_k0 long, {name}_k1 long, {name}_0 long, {name}_1 long"
        return rows.where("fingerprint is not null").select("fingerprint").distinct().mapInArrow(run, kind)

    def differing(mask: tuple[int, int]) -> Column:
        return sum(F.bit_count(F.col(f"query_{i}").bitwiseXOR(F.col(f"found_{i}")).bitwiseAND(F.lit(m - (m >> 63 << 64))))
                   for i, m in enumerate(mask) if m)

    left, right = keyed(queries, "query", flips).drop("query_earlier"), keyed(prints, "found", 0)
    meet = differing(_bits(range(BITS))) <= radius
    for k in ("table", "k0", "k1"):
        meet &= F.col(f"query_{k}") == F.col(f"found_{k}")
    for k, span in enumerate(spans[: max(t[-1] for t in tables)]):
        meet &= (F.col("found_earlier").bitwiseAND(F.lit(1 << k)) == 0) | (differing(_bits(span)) > flips)
    text = [F.concat(*[F.lpad(F.lower(F.hex(f"{name}_{i}")), 16, "0") for i in range(2)]).alias(name) for name in ("query", "found")]
    # The keys asked for grow with the input, so they are never sent to all executors: both sides are dealt by key.
    return left.hint("merge").join(right, meet).select(*text, differing(_bits(range(BITS))).alias("distance"))


def _lanes(fingerprint: str) -> tuple[int, int]:
    return int(fingerprint[:16], 16), int(fingerprint[16:], 16)


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts; for ids divisible by 100 also what is near.

    ``near`` has all fingerprints within RADIUS bits, the document's own first, with their distances; the documents found are the
    rows of the result that have these fingerprints. ``n_near`` is their number, without the document itself.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = settle(edit_and_print(docs))
    queries = done.where("doc_id % 100 = 0")
    sizes = done.groupBy("fingerprint").count()
    near = settle(within_radius(done, queries, RADIUS, BLOCKS, FLIPS).join(sizes.withColumnRenamed("fingerprint", "found"), "found")
                  .groupBy(F.col("query").alias("fingerprint")).agg(
                      (F.sum("count") - 1).alias("n_near"),
                      F.transform(F.array_sort(F.collect_list(F.struct("distance", "found"))), lambda x: F.struct(
                          x["found"].alias("fingerprint"), x["distance"].alias("distance"))).alias("near")))
    asked = queries.select("doc_id", "fingerprint").distinct().join(near, "fingerprint").select("doc_id", "fingerprint", "n_near", "near")
    return done.join(asked, ["doc_id", "fingerprint"], "left").select(*done.columns, "n_near", "near")
