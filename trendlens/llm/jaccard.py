"""N-gram Jaccard join with token-combination prefixes.

A document's set holds its distinct shingles of ``shingle`` words. Two documents link when 100 * intersection >=
``percent`` * union. All sets order their shingles alike: by the logarithm of how many documents hold the shingle's class
(its leading hash bits), then by hash. Sets that link share at least two shingles in their prefixes of
n - ceil(percent * n / 100) + 2, unless they are equal. Shingles whose class is in one document alone can be shared by none:
they are left out of the index, which is most of it. How many of its shingles others hold, and a bitmap of parities, bound
any intersection from above, so most pairs that meet in a list are never compared.

Equal sets are one class. Then the lists of the index are used twice. First each document is compared with one other, the
least document of the list it shares most entries with: groups of near copies fall into few components, at one
comparison a document. Then only lists that still join different components are looked at: entries of rare shingles by
themselves, frequent shingles (lists longer than ``frequent``) only as pairs of two in one prefix; documents of different
components that meet in such a list are compared exactly. Two linked sets share a rare shingle or two frequent ones, so no
link between components is lost.

Counts of shingle classes travel as packed blocks: a block of documents sends its distinct classes to buckets by range and
gets one byte for each back.

Defined cases: null and empty texts and those without words have the empty set, n_shingles 0, and link with nothing; a text
with fewer words has its whole sequence as its one shingle; rows with equal doc_id are one document for links; a null
doc_id links with nothing; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trendlens.llm.components import components
from trendlens.llm.words import slices, text_words, window_hashes
from trendlens.session import settle

CLASS_BITS = 32
#: What is known of a set without its shingles: how many, how many of them other documents hold, and the parity of
#: how many fall on each of 256 places. Two sets differ in at least as many shingles as places.
SHAPE_TYPE = "shape struct<n: bigint, held: bigint, p0: bigint, p1: bigint, p2: bigint, p3: bigint>"


#: A pair that meets in several lists is taken in the first of them. Of its earlier entries a document's entry in a list
#: carries as many as this; more would only save more repetitions of a pair.
KEPT = 48


def shape_of(items: np.ndarray, level: np.ndarray) -> dict[str, int]:
    odd = np.bincount((items & np.uint64(255)).astype(np.int64), minlength=256) & 1
    places = np.packbits(odd.astype(np.uint8)).view("<i8").tolist()
    return {"n": len(items), "held": int((level > 0).sum()), **{f"p{i}": v for i, v in enumerate(places)}}


def shingle_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, in order of value."""
    _, _, _, first, words = text_words(texts, lower=True)
    words = words[:, 0]
    every = window_hashes(words, shingle)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= shingle:
            out.append(np.unique(every[a: b - shingle + 1]))
        else:
            out.append(window_hashes(words[a:b], b - a) if b > a else every[:0])
    return out


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def _text(table: pa.Table | pa.RecordBatch) -> pa.Array:
    column = table.column("text")
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _press(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _numbers(b: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def prefixes(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, text) to doc_id, n_shingles, s1, s2 (a hash of the set) and prefix, the shingles to index."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    bits = max(4, int(np.ceil(np.log2(parts))))
    blocks = max(parts, docs.count() // 256)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn(
        "block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    count_kind = "bucket int, block long, classes binary, more binary"

    def block_classes(table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        sets = shingle_sets(_text(table), shingle)
        each = [np.unique(s >> np.uint64(64 - CLASS_BITS)) for s in sets]
        found, count = np.unique(np.concatenate(each) if each else np.zeros(0, np.uint64), return_counts=True)
        return sets, found, count, np.searchsorted(found, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(CLASS_BITS - bits))

    def send(key, table):
        _, found, count, edge = block_classes(table)
        rows = {"bucket": [], "block": [], "classes": [], "more": []}
        for b in np.flatnonzero(np.diff(edge)).tolist():
            part = found[edge[b]: edge[b + 1]].astype(np.int64)
            many = np.flatnonzero(count[edge[b]: edge[b + 1]] > 1)
            rows["bucket"].append(b)
            rows["block"].append(key[0].as_py())
            rows["classes"].append(_press(np.diff(part, prepend=0)))
            rows["more"].append(_press(np.concatenate([many, count[edge[b]: edge[b + 1]][many]])))
        return pa.Table.from_pydict(rows, schema=count_schema)

    def count_up(key, table):
        rows = table.to_pylist()
        classes = [np.cumsum(_numbers(r["classes"]).astype(np.int64)) for r in rows]
        counts = []
        for r, c in zip(rows, classes):
            n, more = np.ones(len(c), np.int64), _numbers(r["more"]).astype(np.int64)
            n[more[: len(more) // 2]] = more[len(more) // 2:]
            counts.append(n)
        names, at = np.unique(np.concatenate(classes), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts), len(names))
        level = np.floor(np.log2(total)).astype(np.uint32)[at]
        edge = np.cumsum([0, *map(len, classes)])
        return pa.Table.from_pydict({
            "bucket": [r["bucket"] for r in rows], "block": [r["block"] for r in rows],
            "classes": [_press(level[a:b]) for a, b in zip(edge[:-1], edge[1:])], "more": [None] * len(rows)}, schema=count_schema)

    def choose(key, table, levels):
        sets, found, _, edge = block_classes(table)
        level = np.zeros(len(found), np.uint32)
        for r in levels.select(["bucket", "classes"]).to_pylist():
            level[edge[r["bucket"]]: edge[r["bucket"] + 1]] = _numbers(r["classes"])
        out = {name: [] for name in prefix_schema.names}
        for doc, s in zip(table.column("doc_id").to_pylist(), sets):
            digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            n = len(s)
            mine = level[np.searchsorted(found, s >> np.uint64(64 - CLASS_BITS))] if n else np.zeros(0, np.uint32)
            order = np.lexsort((s, mine))[: n + (-n * percent // 100) + 2]
            shared = order[mine[order] > 0]
            for name, value in (("doc_id", doc), ("n_shingles", n), ("shape", shape_of(s, mine)), ("s1", int.from_bytes(digest[:8], "little", signed=True)),
                                ("s2", int.from_bytes(digest[8:], "little", signed=True)), ("prefix", s[shared].tobytes())):
                out[name].append(value)
        return pa.Table.from_pydict(out, schema=prefix_schema)

    prefix_kind = f"doc_id long, n_shingles long, {SHAPE_TYPE}, s1 long, s2 long, prefix binary"
    count_schema, prefix_schema = _arrow(count_kind), _arrow(prefix_kind)
    levels = base.groupBy("block").applyInArrow(send, count_kind).groupBy("bucket").applyInArrow(count_up, count_kind)
    return base.groupBy("block").cogroup(levels.groupBy("block")).applyInArrow(choose, prefix_kind)


def _postings(sets: DataFrame) -> DataFrame:
    """One row per indexed shingle of a set: token, doc, shape."""
    kind = f"token long, doc long, {SHAPE_TYPE}"

    def rows(batches):
        for batch in batches:
            packed = batch.column("prefix").to_pylist()
            at = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) // 8 for x in packed]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(b"".join(packed), "<i8")), batch.column("doc_id").take(at), batch.column("shape").take(at)],
                names=["token", "doc", "shape"])

    return sets.select("doc_id", "shape", "prefix").mapInArrow(rows, kind)


def _sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(doc, items): the whole sets of the documents in ``wanted`` (doc)."""
    kind = "doc long, items binary"

    def rows(batches):
        for part in slices(batches):
            yield pa.RecordBatch.from_pydict({
                "doc": part.column("doc_id"), "items": [s.tobytes() for s in shingle_sets(_text(part), shingle)]}, schema=schema)

    schema = _arrow(kind)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        wanted.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi")
    return chosen.mapInArrow(rows, kind)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    def test(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared) and shared > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], schema=schema)

    schema = _arrow("a long, b long")
    full = pairs.join(sets.select(F.col("doc").alias("a"), F.col("items").alias("x")), "a").join(
        sets.select(F.col("doc").alias("b"), F.col("items").alias("y")), "b")
    return full.select("a", "b", "x", "y").mapInArrow(test, "a long, b long")


def _alike(x: str, y: str, percent: int):
    """Whether two shapes allow a link: an intersection of percent / (100 + percent) of both sizes together."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    apart = sum(F.bit_count(F.col(f"{x}.p{i}").bitwiseXOR(F.col(f"{y}.p{i}"))) for i in range(4))
    most = F.least(F.col(f"{x}.held"), F.col(f"{y}.held"), F.floor((n + m - apart) / 2))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * most >= percent * (n + m))


def jaccard_components(docs: DataFrame, shingle: int = 5, percent: int = 75, frequent: int = 64) -> DataFrame:
    """(doc_id, text) to doc_id, n_shingles, component_id."""
    found = settle(prefixes(docs, shingle, percent))
    named = found.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    can_link = 100 * F.col("shape.held") >= percent * F.col("n_shingles")
    classes = settle(named.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")))
    own = named.join(classes, ["s1", "s2"])
    postings = settle(_postings(own.where((F.col("rep") == F.col("doc_id")) & can_link).dropDuplicates(["doc_id", "s1", "s2"])))
    same_id = own.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a != b")  # equal ids or sets

    lists = settle(postings.groupBy("token").agg(
        F.count(F.lit(1)).alias("size"), F.min(F.struct("doc", "shape")).alias("least")).where("size > 1"))
    index = settle(postings.join(lists, "token"))
    sets = settle(_sets_of(docs, index.select("doc").distinct(), shingle))
    star = index.where((F.col("doc") != F.col("least.doc")) & _alike("shape", "least.shape", percent))
    best = star.groupBy("doc", F.col("least.doc").alias("other")).count().groupBy("doc").agg(
        F.max(F.struct("count", (-F.col("other")).alias("other"))).alias("m"))
    pairs = settle(best.select((-F.col("m.other")).alias("a"), F.col("doc").alias("b")))
    links = settle(_verify(pairs, sets, percent))

    joined = settle(components(links))
    placed = settle(index.join(joined.withColumnRenamed("vertex", "doc"), "doc", "left").select(
        "token", "doc", "shape", "size", F.coalesce("component", "doc").alias("component")))
    open_lists = settle(placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
                        .where("lo != hi").select("token"))
    entries = settle(placed.join(open_lists, "token"))
    own_lists = entries.groupBy("doc", "shape", "component").agg(
        F.array_sort(F.collect_set(F.when(F.col("size") <= frequent, F.col("token")))).alias("rare"),
        F.array_sort(F.collect_set(F.when(F.col("size") > frequent, F.col("token")))).alias("common"))
    one = F.expr(f"transform(rare, (x, i) -> struct(x AS k1, 0L AS k2, slice(rare, 1, least(i, {KEPT})) AS earlier))")
    two = F.expr(f"""flatten(transform(common, (x, i) -> transform(slice(common, i + 2, size(common)), (y, j) -> struct(
        x AS k1, y AS k2, slice(concat(slice(common, 1, i), slice(common, i + 2, j)), 1, {KEPT}) AS earlier))))""")
    keyed = settle(own_lists.select(F.explode(F.concat(one, two)).alias("k"), "doc", "shape", "component").select(
        "k.k1", "k.k2", "k.earlier", "doc", "shape", "component"))

    def side(x: str) -> DataFrame:
        return keyed.select("k1", "k2", *[F.col(c).alias(f"{c}_{x}") for c in ("earlier", "doc", "shape", "component")])

    rest = side("a").join(side("b"), ["k1", "k2"]).where(
        (F.col("doc_a") < F.col("doc_b")) & (F.col("component_a") != F.col("component_b"))
        & _alike("shape_a", "shape_b", percent) & ~F.arrays_overlap("earlier_a", "earlier_b"))
    rest = rest.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))
    more = _verify(settle(rest.distinct()), sets, percent)

    whole = components(links.unionByName(more).unionByName(same_id))
    return found.select("doc_id", "n_shingles").join(whole.withColumnRenamed("vertex", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op4_jaccard(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, least(len(w), 1)))) AS s FROM words)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id
), links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * o >= 75 * (p.n + q.n - o)
), reach AS (
  SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.v
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT v, min(c) AS component_id FROM reach GROUP BY v) ON v = d.doc_id
"""
