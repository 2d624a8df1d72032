"""Merkle manifest of a table: a content-addressed tree of digests, proofs of single rows, and their verification.

H is SHA-256 of the hex texts of digests put together. Rows of one group (say, a source) are leaves in the order of a key;
every ``FANOUT`` consecutive nodes become their H until one node, the group's subroot, is left; the subroots, in the order
of groups, become the root in the same way.

The manifest stores digest-to-children records: the record of a node holds what is below it, level by level, for ``LEVELS``
levels, so that a tree of any height is read in few joins. Equal content is one record. A request for a leaf descends from
the root by the digits of its rank: at each node one child is selected, the others are its siblings on the path. Requests are
folded to their common rank prefixes first, so the root is asked for once per subtree that is wanted, never once per leaf. A
path is collected from the root down and turned round at the end.

Defined cases: nulls are values of their own (``-``); null groups and null keys come first; rows with equal keys are ranked by
leaf digest, and equal rows are leaves of their own; a group of one row has its leaf as subroot; an empty table has no
root and gives no rows; texts are hashed whole. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trendlens.operators.ranking import with_position
from trendlens.session import attach_small, settle

FANOUT, LEVELS = 3, 4
WIDTH = FANOUT ** LEVELS  # leaves below one record
PATH = "array<struct<place: int, siblings: array<binary>>>"


def encoded(value: Column) -> Column:
    """``-`` if null, else UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[encoded(v) for v in values]), 256))


def combine(nodes: list[bytes]) -> bytes:
    """H of digests: SHA-256 of their hex texts put together."""
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


@dataclass(frozen=True)
class Manifest:
    """``leaves``: tree, idx, leaf and what else was asked for; ``trees``: tree, n, group key, digest (the subroot);
    ``records``: digest, height, rows; ``top``: one row like ``trees`` for the tree of subroots."""

    leaves: DataFrame
    trees: DataFrame
    records: DataFrame
    top: DataFrame


def _height(n: Column) -> Column:
    """Levels between ``n`` nodes and their root, at most LEVELS."""
    return sum((n > FANOUT ** i).cast("int") for i in range(LEVELS))


def _tier(n: Column, tier: int) -> Column:
    """Nodes that are left of ``n`` after ``tier`` times LEVELS levels."""
    return F.ceil(n / F.lit(WIDTH ** tier)).cast("long")


def _tiers(biggest: int | None) -> int:
    count, left = 1, biggest or 0
    while left > WIDTH:
        count, left = count + 1, -(-left // WIDTH)
    return count


def _build(nodes: DataFrame, biggest: int | None) -> tuple[list[DataFrame], DataFrame]:
    """Nodes (tree, idx, digest, n) to records, tier by tier, and the root of each tree (tree, digest)."""
    kind = "tree long, idx long, n long, digest binary, height int, rows array<array<binary>>"

    def fold(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                levels = [[x["digest"] for x in r["found"]]]
                for _ in range(r["height"]):
                    below = levels[-1]
                    levels.append([combine(below[i: i + FANOUT]) for i in range(0, len(below), FANOUT)])
                out.append({"tree": r["tree"], "idx": r["idx"], "n": r["n"], "digest": levels[-1][0], "height": r["height"],
                            "rows": levels[-2::-1] if r["height"] else []})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = to_arrow_schema(nodes.sparkSession.createDataFrame([], kind).schema)
    records, roots = [], []
    for _ in range(_tiers(biggest)):
        runs = nodes.groupBy("tree", F.floor(F.col("idx") / WIDTH).alias("seg")).agg(
            F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("found"))
        done = settle(runs.select("tree", F.col("seg").alias("idx"), _tier(F.col("n"), 1).alias("n"), _height(F.col("n")).alias("height"),
                                  "found").mapInArrow(fold, kind))
        records.append(done.select("digest", "height", "rows"))
        roots.append(done.where("n = 1").select("tree", "digest"))
        nodes = done.where("n > 1").select("tree", "idx", "digest", "n")
    found = roots[0]
    for r in roots[1:]:
        found = found.union(r)
    return records, settle(found)


def manifest(docs: DataFrame, columns: list[str], group: str = "source", key: str = "doc_id", **more: Column) -> Manifest:
    """The manifest of all rows. ``more`` names further columns that leaves keep."""
    place = F.monotonically_increasing_id()  # stored with the leaf, so equal rows have an order and spread over range partitions
    group_key = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))  # null first
    rows = settle(docs.select(group_key.alias("group_key"), F.col(key).alias("key"), leaf_digest([F.col(c) for c in columns]).alias("leaf"),
                              place.alias("row"), *[c.alias(name) for name, c in more.items()]))
    placed = with_position(rows, ["group_key", "key", "leaf", "row"], "place")
    sizes = settle(placed.groupBy("group_key").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")))
    trees = settle(with_position(sizes, ["group_key"], "tree"))
    leaves = settle(attach_small(placed, trees, ["group_key"], "inner").select(
        "tree", (F.col("place") - F.col("first")).alias("idx"), "n", "leaf", "key", *more))
    below, subroots = _build(leaves.select("tree", "idx", F.col("leaf").alias("digest"), "n"), trees.agg(F.max("n")).first()[0])
    trees = settle(trees.select("tree", "n", "group_key").join(subroots, "tree"))
    count = trees.count()
    above, root = _build(trees.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest",
                                      F.lit(count).cast("long").alias("n")), count)
    records = below[0]
    for r in [*below[1:], *above]:
        records = records.union(r)
    return Manifest(leaves, trees, settle(records.dropDuplicates(["digest", "height"])),
                    root.withColumn("n", F.lit(count).cast("long")))


def _descend(start: DataFrame, records: DataFrame, wanted: DataFrame, biggest: int | None, keep: list[str]) -> DataFrame:
    """From the roots ``start`` (tree, n, digest, path) to the leaves ``wanted`` (tree, idx, keep…): tree, idx, digest, path, keep….

    ``path`` goes from the root down. Each leaf is to be asked for once.
    """
    spark = start.sparkSession
    tiers = _tiers(biggest)
    asked = [wanted.select("tree", "idx", *keep)]
    for _ in range(tiers - 1):
        asked.append(settle(asked[-1].select("tree", F.floor(F.col("idx") / WIDTH).alias("idx")).distinct()))
    at = None
    for tier in reversed(range(tiers)):
        here = start.where((_tier(F.col("n"), tier + 1) == 1) & ((F.lit(tier) == 0) | (_tier(F.col("n"), tier) > 1))).select(
            "tree", F.lit(0).cast("long").alias("seg"), "n", "digest", "path")
        now = here if at is None else at.withColumnRenamed("idx", "seg").unionByName(here)
        held = keep if tier == 0 else []
        digits = asked[tier].groupBy("tree", F.floor(F.col("idx") / WIDTH).alias("seg")).agg(
            F.collect_list(F.struct((F.col("idx") % WIDTH).cast("int").alias("digit"), *held)).alias("digits"))
        height = F.when(_tier(F.col("n"), tier) > WIDTH, F.lit(LEVELS)).otherwise(_height(_tier(F.col("n"), tier)))
        met = now.withColumn("height", height).join(digits, ["tree", "seg"]).join(records, ["digest", "height"])
        kind = spark.createDataFrame([], f"tree long, idx long, n long, digest binary, path {PATH}").schema
        for c in held:
            kind = kind.add(asked[0].schema[c])
        out = met.select("tree", "seg", "n", "digest", "path", "height", "rows", "digits").mapInArrow(_selector(kind, held), kind)
        at = settle(out) if tier else out
    return at


def _selector(kind, held: list[str]):
    schema = to_arrow_schema(kind)

    def select(batches):
        for batch in batches:
            out = {name: [] for name in schema.names}
            for r in batch.to_pylist():
                for want in r["digits"]:
                    path, below, left = list(r["path"]), r["digest"], want["digit"]
                    for level, row in enumerate(r["rows"], 1):
                        mine = left // FANOUT ** (r["height"] - level)
                        first = mine - mine % FANOUT
                        run = row[first: first + FANOUT]
                        below = run.pop(mine - first)
                        path.append({"place": mine - first, "siblings": run})
                    for name, value in (("tree", r["tree"]), ("idx", r["seg"] * WIDTH + left), ("n", r["n"]), ("digest", below),
                                        ("path", path), *((c, want[c]) for c in held)):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return select


def prove(found: Manifest, wanted: DataFrame, keep: list[str]) -> DataFrame:
    """Proofs of the leaves ``wanted`` (tree, idx, keep…): digest, subroot, root and proof.

    ``proof`` goes from the leaf to the root: at each level the leaf's place in its run, and the others of the run.
    """
    empty = F.expr(f"CAST(array() AS {PATH})")
    trees = settle(wanted.select("tree").distinct())
    asked = settle(trees.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx")))
    n, largest = found.trees.agg(F.count(F.lit(1)), F.max("n")).first()
    roots = settle(_descend(found.top.withColumn("path", empty), found.records, asked, n, []).select(
        F.col("idx").alias("tree"), "digest", "path"))
    start = settle(roots.join(found.trees.select("tree", "n"), "tree"))
    paths = _descend(start, found.records, wanted, largest, keep)
    root = found.top.first()
    ends = found.trees.select("tree", F.col("digest").alias("subroot"), F.lit(bytes(root["digest"]) if root else b"").alias("root"))
    return attach_small(paths, ends, ["tree"], "inner").select(
        *keep, "tree", "idx", "digest", "subroot", "root", F.reverse("path").alias("proof"))


def verify(proofs: DataFrame, claim: str) -> DataFrame:
    """Adds ``folded``, the root recomputed from the digest in column ``claim`` and the proof, and ``siblings``, H of the
    proof's digests from the leaf up, left to right."""
    kind = StructType([*proofs.schema.fields]).add("folded", "binary").add("siblings", "binary")
    schema = to_arrow_schema(kind)

    def fold(batches):
        for batch in batches:
            folded, siblings = [], []
            for node, proof in zip(batch.column(claim).to_pylist(), batch.column("proof").to_pylist()):
                for step in proof:
                    run = step["siblings"]
                    node = combine([*run[: step["place"]], node, *run[step["place"]:]])
                folded.append(node)
                siblings.append(combine([s for step in proof for s in step["siblings"]]))
            columns = [*batch.columns, pa.array(folded, pa.binary()), pa.array(siblings, pa.binary())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return proofs.mapInArrow(fold, kind)


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def tampered_digest(columns: list[str]) -> Column:
    """The leaf as it is after line breaks were deleted from the texts of every document whose id has an even CRC-32."""
    values = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in columns]
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return F.when(hit, leaf_digest(values)).otherwise(leaf_digest([F.col(c) for c in columns]))


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    """Proofs of all documents, verified after some were tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = manifest(docs, COLUMNS, tampered=tampered_digest(COLUMNS))
    proofs = prove(found, found.leaves, ["key", "tampered"])
    hexed = lambda c: F.lower(F.hex(c))
    return verify(proofs, "tampered").select(
        F.col("key").alias("doc_id"), hexed("digest").alias("leaf"), hexed("subroot").alias("subroot"), hexed("root").alias("root"),
        hexed("siblings").alias("proof_sha256"), hexed("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"))


_H = "sha256(concat({}))".format(", ".join(
    f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in COLUMNS))
ORACLE_SQL = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), leaves AS (
  SELECT doc_id, source, leaf, CASE WHEN list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(strlen(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT)),
      lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)) & 1 = 1
    THEN (SELECT {_H.replace("text::", "replace(text, chr(10), '')::")}) ELSE leaf END AS claim
  FROM (SELECT *, {_H} AS leaf FROM documents), crc
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaves
), up AS (
  SELECT 0 AS lvl, tree, idx, leaf AS d, n FROM ranked
  UNION ALL
  SELECT lvl + 1, tree, idx // 3, sha256(string_agg(d, '' ORDER BY idx)), (n + 2) // 3
  FROM up WHERE n > 1 GROUP BY lvl, tree, idx // 3, n
), subroots AS (
  SELECT tree, d, lvl AS depth, count(*) OVER () AS k FROM up WHERE n = 1
), over AS (
  SELECT 0 AS lvl, tree AS idx, d, k AS n FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 3, sha256(string_agg(d, '' ORDER BY idx)), (n + 2) // 3 FROM over WHERE n > 1 GROUP BY lvl, idx // 3, n
), sides AS (
  SELECT r.tree, r.idx, u.lvl, string_agg(u.d, '' ORDER BY u.idx) FILTER (u.idx < r.idx // (3 ** u.lvl)::BIGINT) AS lower,
    string_agg(u.d, '' ORDER BY u.idx) FILTER (u.idx > r.idx // (3 ** u.lvl)::BIGINT) AS upper
  FROM ranked r JOIN up u ON r.tree = u.tree AND u.n > 1 AND u.idx // 3 = r.idx // (3 ** (u.lvl + 1))::BIGINT GROUP BY ALL
  UNION ALL
  SELECT r.tree, r.idx, s.depth + u.lvl, string_agg(u.d, '' ORDER BY u.idx) FILTER (u.idx < r.tree // (3 ** u.lvl)::BIGINT),
    string_agg(u.d, '' ORDER BY u.idx) FILTER (u.idx > r.tree // (3 ** u.lvl)::BIGINT)
  FROM ranked r JOIN subroots s USING (tree) JOIN over u ON u.n > 1 AND u.idx // 3 = r.tree // (3 ** (u.lvl + 1))::BIGINT
  GROUP BY r.tree, r.idx, s.depth, u.lvl
), folded AS (
  SELECT 0::BIGINT AS lvl, tree, idx, claim AS d FROM ranked
  UNION ALL
  SELECT f.lvl + 1, f.tree, f.idx, sha256(coalesce(lower, '') || d || coalesce(upper, ''))
  FROM folded f JOIN sides s ON s.tree = f.tree AND s.idx = f.idx AND s.lvl = f.lvl
), last AS (
  SELECT tree, idx, arg_max(d, lvl) AS folded_root FROM folded GROUP BY tree, idx
), proof AS (
  SELECT tree, idx, sha256(string_agg(coalesce(lower, '') || coalesce(upper, ''), '' ORDER BY lvl)) AS proof_sha256
  FROM sides GROUP BY tree, idx
)
SELECT doc_id, leaf, s.d AS subroot, o.d AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root,
  folded_root = o.d AS verified
FROM ranked JOIN subroots s USING (tree) CROSS JOIN (SELECT d FROM over WHERE n = 1) o JOIN last USING (tree, idx) LEFT JOIN proof USING (tree, idx)
"""
