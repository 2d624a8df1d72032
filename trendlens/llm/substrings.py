"""Removal of passages that an earlier document holds, by level-wise doubling of repeated windows.

For windows of ``window`` words the levels are window/4, window/2, window (rounded up). At the first level each text
gives those short windows that are least by hash among the ones of some full window: any two copies of a full window
choose the same. Only windows that occur in different texts are extended, to the right and to the left, to twice their
length; only those that are still repeated go to the next level, until the full length is reached or none survives.
Full windows are compared by 128-bit hashes, and covered words are removed.

Documents whose word sequences are equal are found first: all words of the later ones are covered if they have a window
at all, and only the first takes part in the levels. Only texts with surviving windows are read again.

Defined cases: a null text has no words; a document with null id neither loses words nor makes others lose any; rows with
equal ids are neither's predecessor; repeated rows are judged alike; an empty table gives no rows; further columns are
ignored. Texts of any length are handled as a whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trendlens.llm.words import joined_words, sliding, slices, text_words, window_hashes
from trendlens.session import settle

FOUND = "doc_id long, n_words long, seq long, seq2 long, kept_sha256 string, anchors binary, places binary"
WINDOW = "hash long, hash2 long, doc_id long, seq long, place int"


def _sequence(words: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a document's words."""
    digest = hashlib.blake2b(words.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def levels(window: int) -> list[int]:
    return sorted({-(-window // 4), -(-window // 2), window})


def first_level(docs: DataFrame, window: int) -> DataFrame:
    """One row per document: its digest if nothing is removed, its sequence hash, and the chosen shortest windows."""
    short = levels(window)[0]

    def choose(batches):
        for part in slices(batches):
            raw, starts, ends, first, words = text_words(part.column(1))
            hashes = window_hashes(words[:, 0], short)
            chosen = np.zeros(len(words), bool)
            if len(words) >= window:
                row_end = np.repeat(first[1:], np.diff(first))
                at = np.arange(len(words))
                inside = hashes.copy()
                inside[at[: len(hashes)] + short > row_end[: len(hashes)]] = np.iinfo(np.uint64).max
                least = sliding(inside, window - short + 1)
                least[at[: len(least)] + window > row_end[: len(least)]] = 0
                reach = window - short
                padded = np.concatenate([np.zeros(reach, np.uint64), least, np.zeros(reach, np.uint64)])
                most = sliding(padded, reach + 1, np.maximum)  # over the full windows that hold the place
                chosen[: len(most)] = (most == inside) & (most > 0)
            places = np.flatnonzero(chosen)
            edge = np.searchsorted(places, first)
            out = {name: [] for name in schema.names}
            for key, a, b, x, y in zip(part.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), edge[:-1], edge[1:]):
                seq, seq2 = _sequence(words[a:b])
                mine = places[x:y]
                for name, value in (("doc_id", key), ("n_words", b - a), ("seq", seq), ("seq2", seq2),
                                    ("kept_sha256", hashlib.sha256(joined_words(raw, starts[a:b], ends[a:b])).hexdigest()),
                                    ("anchors", hashes[mine].tobytes()), ("places", (mine - a).astype("<i4").tobytes())):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = _arrow(FOUND)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(choose, FOUND)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def _unpack(found: DataFrame) -> DataFrame:
    """One row per chosen window."""
    def rows(batches):
        for batch in batches:
            anchors = np.frombuffer(b"".join(batch.column("anchors").to_pylist()), "<i8")
            places = np.frombuffer(b"".join(batch.column("places").to_pylist()), "<i4")
            count = [len(x) // 8 for x in batch.column("anchors").to_pylist()]
            rep = lambda c: np.repeat(batch.column(c).to_numpy(zero_copy_only=False), count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors), pa.array(np.zeros(len(anchors), np.int64)), pa.array(rep("doc_id").astype(np.int64)),
                 pa.array(rep("seq").astype(np.int64)), pa.array(places)], schema=schema)

    schema = _arrow(WINDOW)
    return found.select("doc_id", "seq", "anchors", "places").mapInArrow(rows, WINDOW)


def _repeated(windows: DataFrame) -> DataFrame:
    """Windows that occur in different texts, with the least document that holds them.

    The aggregate is written first, so that the join sees two plain sides and can split a hot window.
    """
    firsts = settle(windows.groupBy("hash", "hash2").agg(
        F.min("seq").alias("a"), F.max("seq").alias("b"), F.min("doc_id").alias("least")).where("a != b").drop("a", "b"))
    return windows.join(firsts, ["hash", "hash2"])


def _extend(docs: DataFrame, survivors: DataFrame, have: int, to: int, window: int) -> DataFrame:
    """Read the survivors' texts again and give longer windows: two extensions of each, or all full windows."""
    def longer(batches):
        for part in slices(batches):
            raw, starts, ends, first, words = text_words(part.column(1))
            out = {name: [] for name in schema.names}
            for key, held, a, b in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), first[:-1], first[1:]):
                own = words[a:b]
                seq, _ = _sequence(own)
                places = np.array(sorted({p for h in held if h["seq"] == seq for p in h["places"]}), np.int64)
                if not len(places):
                    continue
                hashes, hashes2 = window_hashes(own[:, 0], to), window_hashes(own[:, 1], to)
                if to == window:
                    new = np.unique((places[:, None] - np.arange(window - have + 1)).ravel())
                else:
                    new = np.unique(np.concatenate([places, places + have - to]))
                new = new[(new >= 0) & (new < len(hashes))]
                for name, value in (("hash", hashes[new].view(np.int64)), ("hash2", hashes2[new].view(np.int64)),
                                    ("doc_id", np.full(len(new), key)), ("seq", np.full(len(new), seq)),
                                    ("place", new.astype(np.int32))):
                    out[name].append(value)
            if out["hash"]:
                yield pa.RecordBatch.from_pydict({k: np.concatenate(v) for k, v in out.items()}, schema=schema)

    schema = _arrow(WINDOW)
    held = _by_document(survivors)
    return docs.select(F.col("doc_id").cast("long"), "text").join(held, "doc_id").mapInArrow(longer, WINDOW)


def _cut(docs: DataFrame, covered: DataFrame, window: int) -> DataFrame:
    """Read the texts that lose words again and give what is left."""
    kind = "doc_id long, seq long, n_removed long, cut_sha256 string, kept string"

    def remove(batches):
        for part in slices(batches):
            raw, starts, ends, first, words = text_words(part.column(1))
            out: list[dict] = []
            for key, held, a, b in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), first[:-1], first[1:]):
                seq, _ = _sequence(words[a:b])
                places = [p for h in held if h["seq"] == seq for p in h["places"]]
                if not places:
                    continue
                edge = np.zeros(b - a + 1, np.int64)
                np.add.at(edge, places, 1)
                np.add.at(edge, np.array(places) + window, -1)
                keep = np.cumsum(edge[:-1]) == 0
                left = joined_words(raw, starts[a:b][keep], ends[a:b][keep])
                out.append({"doc_id": key, "seq": seq, "n_removed": int((~keep).sum()), "kept": left.decode(),
                            "cut_sha256": hashlib.sha256(left).hexdigest()})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = _arrow(kind)
    held = _by_document(covered)
    done = docs.select(F.col("doc_id").cast("long"), "text").join(held, "doc_id").mapInArrow(remove, kind)
    return done.dropDuplicates(["doc_id", "seq"])


def _by_document(places: DataFrame) -> DataFrame:
    """doc_id to its (seq, places): one row per id, so repeated ids are not multiplied."""
    each = places.groupBy("doc_id", "seq").agg(F.collect_set("place").alias("places"))
    return settle(each.groupBy("doc_id").agg(F.collect_list(F.struct("seq", "places")).alias("held")))


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, text) to one row per document: doc_id, n_words, n_removed, kept_sha256, kept.

    ``kept`` is null where nothing is removed: the words of the text itself.
    """
    steps = levels(window)
    found = settle(first_level(docs, window))
    firsts = settle(found.where(F.col("doc_id").isNotNull()).groupBy("seq", "seq2").agg(F.min("doc_id").alias("first")))
    known = settle(found.drop("anchors", "places").join(firsts, ["seq", "seq2"], "left").withColumn(
        "later", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))))
    windows = _unpack(found.where(F.col("doc_id").isNotNull()))
    later = known.where("later").select("doc_id", "seq").distinct()
    survivors = settle(_repeated(windows).join(later, ["doc_id", "seq"], "left_anti"))
    for have, to in zip(steps[:-1], steps[1:]):
        if survivors.isEmpty():
            break
        survivors = settle(_repeated(settle(_extend(docs, survivors, have, to, window))))
    cut = settle(_cut(docs, survivors.where("least < doc_id"), window))
    return known.join(cut, ["doc_id", "seq"], "left").select(
        "doc_id", "n_words",
        F.when(F.col("later") & (F.col("n_words") >= window), F.col("n_words")).otherwise(
            F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("later") & (F.col("n_words") >= window), F.sha2(F.lit("").cast("binary"), 256)).otherwise(
            F.coalesce("cut_sha256", "kept_sha256")).alias("kept_sha256"),
        F.when(F.col("later") & (F.col("n_words") >= window), "").otherwise(F.col("kept")).alias("kept"))


def op7_substrings(spark, sf_dir: str) -> DataFrame:
    """Remove from all documents what a document with a smaller id holds in 50 or more consecutive words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).drop("kept")


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, s, array_to_string(w[s:s + 49], ' ') AS passage
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS s FROM words)
), covered AS (
  SELECT DISTINCT doc_id, i FROM (
    SELECT doc_id, unnest(generate_series(s, s + 49)) AS i
    FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY passage) AS least FROM windows) WHERE least < doc_id)
), each AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept
  FROM each ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
