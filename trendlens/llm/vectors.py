"""Near-duplicate vectors by product quantisation.

Unit vectors are put in coarse inverted lists; what is left after the list's centre is coded by subspace. A vector, as
query, probes every list that can hold a partner: if cosine(q, x) >= t then |q - x| <= r = sqrt(2 - 2t), so x cannot be
in list c unless q.(c' - c) <= r |c' - c| for q's own centre c'. In a list, distances to the coded vectors come from
table look-ups; with the stored coding error they bound the true distance from below, and only pairs that the bound
allows are compared exactly, in double precision. So probes and candidates always suffice, however poor the codes.

Equal vectors are one class with a multiplicity. Lists are dealt in tiles of at most ``tile`` members and ``tile`` queries;
a tile gives link counts and a spanning forest of its links, not its pairs.

The centres are fitted on at most ``sample`` distinct vectors, those with the least hash; every vector is indexed.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those with null label or null
id, link with nothing; vectors of different length never link; repeated rows are vectors of their own, so they link; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trendlens.llm.components import components
from trendlens.session import settle


def _kmeans(points: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        nearest = (points @ centres.T - 0.5 * (centres ** 2).sum(axis=1)).argmax(axis=1)
        for dim in range(points.shape[1]):
            sums = np.bincount(nearest, points[:, dim], len(centres))
            count = np.bincount(nearest, minlength=len(centres))
            centres[:, dim] = np.where(count > 0, sums / np.maximum(count, 1), centres[:, dim])
    return centres


def fit(sample: np.ndarray, lists: int, subspaces: int, codes: int) -> dict:
    """Centres of the lists, and code books of the residuals. Lists are assigned by inner product with unit centres."""
    centres = _kmeans(sample, min(lists, len(sample)), 8, 1)
    size = np.linalg.norm(centres, axis=1, keepdims=True)
    centres = np.where(size > 0, centres / np.maximum(size, 1e-12), centres)
    rest = sample - centres[(sample @ centres.T).argmax(axis=1)]
    cuts = np.array_split(np.arange(sample.shape[1]), min(subspaces, sample.shape[1]))
    books = [_kmeans(np.ascontiguousarray(rest[:, c]), min(codes, len(rest)), 6, 2 + i) for i, c in enumerate(cuts)]
    return {"centres": centres, "cuts": cuts, "books": books}


def code(unit: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """List, codes and the coded vectors."""
    lists = (unit @ model["centres"].T).argmax(axis=1)
    rest = unit - model["centres"][lists]
    codes, near = np.zeros((len(unit), len(model["cuts"])), np.uint8), model["centres"][lists].copy()
    for i, (cut, book) in enumerate(zip(model["cuts"], model["books"])):
        codes[:, i] = (rest[:, cut] @ book.T - 0.5 * (book ** 2).sum(axis=1)).argmax(axis=1)
        near[:, cut] += book[codes[:, i]]
    return lists, codes, near


def probes(unit: np.ndarray, model: dict, radius: float) -> np.ndarray:
    """Which lists each query has to look at: boolean (queries, lists)."""
    inner = unit @ model["centres"].T
    own = inner.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * model["centres"] @ model["centres"].T))
    return inner.max(axis=1)[:, None] - inner <= radius * apart[own] + 1e-9


def _links(queries, members, model: dict, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, member) with exact cosine >= ``cosine``. Both: ids, vectors (double, as given), norms, unit."""
    q_id, q_raw, q_norm, q_unit = queries
    m_id, m_raw, m_norm, m_unit = members
    radius = np.sqrt(2 - 2 * cosine)
    lists, codes, near = code(m_unit, model)
    error = np.linalg.norm(m_unit - near, axis=1)
    size = (near ** 2).sum(axis=1)
    limit = (radius + error + 1e-6) ** 2
    found_q, found_m = [], []
    for a in range(0, len(q_id), 256):
        part = q_unit[a: a + 256]
        inner = (part @ model["centres"].T)[:, lists]
        for i, (cut, book) in enumerate(zip(model["cuts"], model["books"])):
            inner += (part[:, cut] @ book.T)[:, codes[:, i]]
        q, m = np.nonzero(1 + size - 2 * inner <= limit)
        exact = np.einsum("ij,ij->i", q_raw[q + a], m_raw[m]) / (q_norm[q + a] * m_norm[m])
        good = (exact >= cosine) & (q_id[q + a] != m_id[m])
        found_q.append(q[good] + a)
        found_m.append(m[good])
    return np.concatenate(found_q), np.concatenate(found_m)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same vertices as (a, b), at most one per vertex."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a):]
    label = np.arange(len(names))
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def _matrix(column: pa.ChunkedArray | pa.Array, width: int):
    """Vectors as given (double), norms and unit vectors, padded with zeros to ``width``."""
    rows = column.to_pylist()
    raw = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        raw[i, : len(r)] = r
    norm = np.sqrt(np.einsum("ij,ij->i", raw, raw))
    return raw, norm, raw / norm[:, None]


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, subspaces: int = 8, codes: int = 64, sample: int = 8_000,
                    tile: int = 2_048) -> DataFrame:
    """(vec_id, embedding, label) to vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)) & F.coalesce(
        F.exists("embedding", lambda x: x != 0), F.lit(False))
    key = ["label", "dim", "h1", "h2"]
    rows = settle(vectors.select(
        F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>").alias("embedding"),
        F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"),
        sound.alias("sound")))
    classes = settle(rows.where("sound").groupBy(*key).agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("embedding").alias("embedding")))
    size = classes.agg(F.count(F.lit(1)), F.max("dim")).first()
    n, width = size[0], size[1]
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.col("vec_id").isNotNull().alias("kept"))
    share = int(min(1.0, sample / n) * (1 << 30))
    drawn = classes.where(F.pmod("h1", F.lit(1 << 30)) <= share).select("embedding").limit(2 * sample).toArrow()
    if not drawn.num_rows:
        drawn = classes.select("embedding").limit(sample).toArrow()
    lists = max(1, int(np.sqrt(n) / 8))
    model = fit(_matrix(drawn.column(0), width)[2], lists, subspaces, codes)
    radius = float(np.sqrt(2 - 2 * cosine))

    dealt = "label long, dim int, list int, rep long, copies long, embedding array<double>"

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _matrix(batch.column("embedding"), width)[2]
            wanted = probes(unit, model, radius)
            own = (unit @ model["centres"].T).argmax(axis=1)
            for queries in (False, True):
                row, place = np.nonzero(wanted) if queries else (np.arange(len(own)), own)
                part = batch.take(pa.array(row)) if queries else batch
                yield pa.RecordBatch.from_arrays(
                    [part.column("label").cast(pa.int64()), part.column("dim"), pa.array(place.astype(np.int32)),
                     part.column("rep"), (pa.array(np.zeros(len(row), np.int64)) if queries else part.column("copies")),
                     part.column("embedding").cast(pa.list_(pa.float64()))], schema=deal_schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    deal_schema = to_arrow_schema(StructType.fromDDL(dealt))
    both = settle(classes.select("label", "dim", "rep", "copies", "embedding").mapInArrow(deal, dealt))
    place = ["label", "dim", "list"]
    counts = settle(both.groupBy(*place).agg(
        F.ceil(F.count(F.when(F.col("copies") > 0, 1)) / tile).cast("int").alias("member_tiles"),
        F.ceil(F.count(F.when(F.col("copies") == 0, 1)) / tile).cast("int").alias("query_tiles")).where("member_tiles > 0 and query_tiles > 0"))
    tiled = both.join(counts, place)
    spot = lambda tiles: F.pmod(F.xxhash64("rep"), F.col(tiles)).cast("int")
    every = lambda tiles: F.explode(F.sequence(F.lit(0), F.col(tiles) - 1))
    members = tiled.where("copies > 0").select(*place, spot("member_tiles").alias("mt"), every("query_tiles").alias("qt"), "rep", "copies", "embedding")
    queries = tiled.where("copies = 0").select(*place, every("member_tiles").alias("mt"), spot("query_tiles").alias("qt"), "rep", "embedding")
    tile_key = [*place, "mt", "qt"]
    members, queries = members.toDF(*members.columns), queries.toDF(*queries.columns)  # columns of their own each

    def compare(left, right):
        if not left.num_rows or not right.num_rows:
            return out_schema.empty_table()
        m, q = _matrix(left.column("embedding"), width), _matrix(right.column("embedding"), width)
        m_id, q_id = left.column("rep").to_numpy(), right.column("rep").to_numpy()
        a, b = _links((q_id, *q), (m_id, *m), model, cosine)
        weight = np.bincount(a, left.column("copies").to_numpy()[b], len(q_id)).astype(np.int64)
        hit = np.flatnonzero(weight)
        x, y = _forest(q_id[a], m_id[b])
        return pa.Table.from_arrays(
            [pa.array(np.concatenate([q_id[hit], x])), pa.array(np.concatenate([weight[hit], np.zeros(len(x), np.int64)])),
             pa.array(np.concatenate([q_id[hit], y]))], schema=out_schema)

    kind = "a long, links long, b long"
    out_schema = to_arrow_schema(StructType.fromDDL(kind))
    found = settle(members.groupBy(*tile_key).cogroup(queries.groupBy(*tile_key)).applyInArrow(compare, kind))
    links = found.where("links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    joined = components(found.where("links = 0").select("a", "b"))
    reps = settle(classes.drop("embedding").join(links, "rep", "left").join(
        joined.withColumnRenamed("vertex", "rep"), "rep", "left").select(
        *key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    sound_rows = rows.where("sound").drop("embedding").join(reps, key)
    others = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return sound_rows.select("vec_id", "n_links", "component_id").unionByName(others).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2_vectors(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings within their labels."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


ORACLE_SQL = """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS v, vec_id AS c FROM embeddings
  UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.v
), least AS (SELECT v, min(c) AS component_id FROM reach GROUP BY v),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON v = vec_id LEFT JOIN counted ON a = vec_id
"""
