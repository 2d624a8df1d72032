"""Text and embedding classifiers as Spark ML pipelines."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import (
    CountVectorizerModel, ElementwiseProduct, IndexToString, NGram, Normalizer, RegexTokenizer,
    SQLTransformer, StringIndexer,
)
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trendlens.functions.text import TOKEN
from trendlens.operators.features import MAX_DF, MAX_FEATURES, row_vocabulary
from trendlens.session import attach_small, settle


def _terms_stages(text: str) -> list:
    return [
        RegexTokenizer(inputCol=text, outputCol="_w1", pattern=TOKEN, gaps=False, toLowercase=True),
        NGram(n=2, inputCol="_w1", outputCol="_w2"),
        NGram(n=3, inputCol="_w1", outputCol="_w3"),
        SQLTransformer(statement="SELECT *, concat(_w1, _w2, _w3) AS _terms FROM __THIS__"),
    ]


def fit_text_features(
    df: DataFrame, text: str = "text", max_features: int = MAX_FEATURES, min_df: int = 1, max_df: float = MAX_DF
) -> PipelineModel:
    """Word 1–3-gram tf-idf with smoothed idf (``ln((1+n)/(1+df)) + 1``) and unit rows."""
    n_docs = F.lit(df.count())
    # at most max_features rows, most frequent first
    known = row_vocabulary(df, text, n_docs, max_features, min_df, max_df).orderBy(F.desc("cf"), "term").select(
        "term", F.log((n_docs + 1) / (F.col("df") + 1)).alias("idf")).toArrow()
    counter = CountVectorizerModel.from_vocabulary(known.column("term").to_pylist(), inputCol="_terms", outputCol="_tf")
    idf = known.column("idf").to_numpy()
    scale = ElementwiseProduct(scalingVec=Vectors.dense(idf + 1.0), inputCol="_tf", outputCol="_tfidf")
    unit = Normalizer(p=2.0, inputCol="_tfidf", outputCol="features")
    tidy = SQLTransformer(statement="SELECT * EXCEPT (_w1, _w2, _w3, _terms, _tf, _tfidf) FROM __THIS__")
    return PipelineModel(stages=[*_terms_stages(text), counter, scale, unit, tidy])


def with_class_weights(df: DataFrame, label: str = "label", weight: str = "weight") -> DataFrame:
    """Balanced weights ``n / (classes · n_class)``; one row per class is joined back."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    everything = W.partitionBy()
    weights = sizes.select(
        label, (F.sum("_n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("_n"))).alias(weight)
    )
    return attach_small(df, weights, [label], "inner")


def _sparse(df: DataFrame, features: str, *others: str) -> DataFrame:
    """A vector column as ``size``, ``at`` and ``val``, next to other columns."""
    read = df.select(*others, F.unwrap_udt(features).alias("v"))
    size = F.coalesce("v.size", F.size("v.values"))
    at = F.coalesce("v.indices", F.sequence(F.lit(0), F.size("v.values") - 1))
    return read.select(*others, size.alias("size"), at.alias("at"), F.col("v.values").alias("val"))


MEMORY = 40  # steps the descent remembers, two vectors each; with few it takes twice the passes
CHUNK = 8192  # gradient values in a row, so that adding up is spread over tasks
BLOCK = 1 << 16  # feature values in a stored row, or those of one row
# rows are about a megabyte: short row groups, else a reader holds hundreds of them
ROW_GROUPS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 4, "parquet.page.size.row.check.min": 4}
PARTS = {"y": np.int32, "w": np.float64, "count": np.int32, "at": np.int32, "val": np.float64}
SAMPLE = 3000  # rows, about, whose curvature the steps are scaled by


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows of y, w, at and val as arrays of many rows in one value, with their total weight and largest size."""

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = np.cumsum(pc.list_value_length(batch.column("at")).to_numpy())
            cuts = [0, *(np.flatnonzero(np.diff(ends // BLOCK)) + 1).tolist(), batch.num_rows]
            found = []
            for part in (batch.slice(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])):
                held = {c: part.column(c) for c in ("y", "w", "at", "val")}
                held |= {"count": pc.list_value_length(held["at"]), "at": held["at"].flatten(), "val": held["val"].flatten()}
                bare = {c: held[c].to_numpy(zero_copy_only=False).astype(kind).tobytes() for c, kind in PARTS.items()}
                found.append(bare | {"total": pc.sum(held["w"]).as_py(), "size": pc.max(part.column("size")).as_py()})
            yield pa.RecordBatch.from_pylist(found)

    kinds = ", ".join(f"{c} binary" for c in PARTS)
    return rows.select("y", "w", "size", "at", "val").mapInArrow(pack, f"{kinds}, total double, size long")


def _unpacked(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            y, w, count, at, val = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in PARTS.items())
            yield y, w, count, at.astype(np.intp), val  # numpy takes and counts by any other kind far slower


def _shares(score: np.ndarray) -> np.ndarray:
    """Softmax over the first axis."""
    p = np.exp(score - score.max(axis=0))
    return p / p.sum(axis=0)


def _scores(theta: np.ndarray, count: np.ndarray, at: np.ndarray, val: np.ndarray) -> np.ndarray:
    """classes x rows, less those of the last class."""
    lead, score = theta[:-1] - theta[-1], np.zeros((len(theta), len(count)))
    some = np.flatnonzero(count)
    starts = (np.cumsum(count) - count)[some]
    for c, values in enumerate(lead):
        score[c] = values[-1]
        if len(some):
            score[c, some] += np.add.reduceat(values.take(at) * val, starts)
    return score


def _gradient(blocks: DataFrame, theta: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted log loss and its gradient, summed over all rows. ``theta``: classes x (features, intercept)."""
    classes, width = theta.shape

    def partial(batches):
        loss, total = 0.0, np.zeros((classes, width))
        for y, w, count, at, val in _unpacked(batches):
            row = np.repeat(np.arange(len(y)), count)
            p = _shares(_scores(theta, count, at, val))
            own = (y, np.arange(len(y)))
            loss -= float(w @ np.log(np.maximum(p[own], 1e-300)))
            p[own] -= 1
            p *= w
            for c in range(classes - 1):
                total[c, :-1] += np.bincount(at, p[c].take(row) * val, width - 1)
            total[:-1, -1] += p[:-1].sum(axis=1)
        total[-1] = -total[:-1].sum(axis=0)  # a row's shares add up to 1
        flat = np.append(total.ravel(), loss)
        yield pa.RecordBatch.from_pydict({
            "chunk": np.arange(0, len(flat), CHUNK) // CHUNK,
            "vals": [flat[i: i + CHUNK].tobytes() for i in range(0, len(flat), CHUNK)]})

    def add(key, table):
        parts = np.sum([np.frombuffer(v) for v in table.column("vals").to_pylist()], axis=0)
        return pa.table({"chunk": [key[0].as_py()], "vals": [parts.tobytes()]})

    few = blocks.coalesce(2 * blocks.sparkSession.sparkContext.defaultParallelism)  # one gradient to a task
    parts = few.mapInArrow(partial, "chunk long, vals binary").groupBy("chunk").applyInArrow(add, "chunk long, vals binary")
    done = parts.toArrow().sort_by("chunk")
    flat = np.concatenate([np.frombuffer(v) for v in done.column("vals").to_pylist()])
    return float(flat[-1]), flat[:-1].reshape(classes, width)


def _picked(blocks: DataFrame, total: float) -> list[np.ndarray]:
    """About ``SAMPLE`` rows, picked with a chance by weight: weight over chance, chance, number of values, at, val."""

    def pick(batches):
        for y, w, count, at, val in _unpacked(batches):
            chance = np.minimum(1, SAMPLE * w / total)
            hit = np.random.default_rng(zlib.crc32(at.tobytes())).random(len(y)) < chance
            if hit.any():
                of = np.repeat(hit, count)
                yield pa.RecordBatch.from_pydict({"part": [v.tobytes() for v in (
                    w[hit] / chance[hit], chance[hit], count[hit], at[of], val[of])], "kind": list(range(5))})

    found = blocks.mapInArrow(pick, "part binary, kind long").toArrow()
    kinds = (np.float64, np.float64, np.int32, np.intp, np.float64)
    parts = [found.filter(pc.equal(found.column("kind"), i)).column("part").to_pylist() for i in range(5)]
    return [np.frombuffer(b"".join(part), kind) for part, kind in zip(parts, kinds)]


def _products(row: np.ndarray, at: np.ndarray, val: np.ndarray, n: int) -> np.ndarray:
    """Inner products of all pairs of sparse rows."""
    order = np.argsort(at, kind="stable")
    row, val = row[order], val[order]
    _, start, size = np.unique(at[order], return_index=True, return_counts=True)
    out = np.zeros(n * n)
    common = size >= 24
    for m in np.unique(size[~common]):  # rare features: their pairs of rows
        of = start[size == m][:, None] + np.arange(m)
        pairs = (row[of][:, :, None] * n + row[of][:, None, :]).ravel()
        np.add.at(out, pairs, (val[of][:, :, None] * val[of][:, None, :]).ravel())
    out = out.reshape(n, n)
    where, starts, sizes = np.flatnonzero(common), start[common], size[common]
    for i in range(0, len(where), 1024):  # others: columns of a dense block
        of = np.concatenate([np.arange(a, a + m) for a, m in zip(starts[i: i + 1024], sizes[i: i + 1024])])
        block = np.zeros((n, min(1024, len(where) - i)))
        block[row[of], np.repeat(np.arange(block.shape[1]), sizes[i: i + 1024])] = val[of]
        out += block @ block.T
    return out


def _curvature(blocks: DataFrame, total: float, strength: float, shape: tuple[int, int]):
    """At a point, a function that takes a gradient to about the step that ends it: the inverse of the curvature of some rows.

    Only the way to the minimum depends on the rows picked, not the minimum. Curvature that they miss counts as ``floor``.
    """
    w, chance, count, at, val = _picked(blocks, total)
    n, row = len(w), np.repeat(np.arange(len(w)), count)
    products, norm = _products(row, at, val, n) + 1, np.bincount(row, val * val, n)

    def at_point(flat: np.ndarray):
        p = _shares(_scores(flat.reshape(shape), count, at, val))
        each = w / total * (p * (1 - p)).sum(axis=0) / max(shape[0] - 1, 1)
        floor = max(strength, float((each * norm)[chance < 1].sum()) / SAMPLE)
        root = np.sqrt(each)
        inverse = np.linalg.inv(root[:, None] * products * root + floor * np.eye(n))

        def step(gradient: np.ndarray) -> np.ndarray:
            out = gradient.reshape(shape).copy()
            for g in out:
                part = inverse @ ((np.bincount(row, g.take(at) * val, n) + g[-1]) * root) * root
                g[:-1] -= np.bincount(at, part.take(row) * val, shape[1] - 1)
                g[-1] -= part.sum()
            return out.ravel() / floor

        return step

    return at_point


def _descend(objective, start: np.ndarray, tol: float, max_iter: int, curvature=None) -> tuple[np.ndarray, float, int]:
    """Limited-memory quasi-Newton steps until no gradient value is above ``tol``: point, largest gradient value, steps.

    ``curvature`` gives at a point what scales the steps; it is asked at the start and at steps 8, 16, 32 and so on.
    """
    x, (f, g) = start, objective(start)
    scaled = curvature(start) if curvature else np.copy
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for turn in range(1, max_iter + 1):
        if np.abs(g).max() <= tol:
            return x, float(np.abs(g).max()), turn - 1
        if curvature and turn >= 8 and turn & (turn - 1) == 0:
            scaled = curvature(x)
        d, kept = -g, []
        for s, y in reversed(steps):
            share = (s @ d) / (s @ y)
            kept.append(share)
            d = d - share * y
        d = scaled(d)
        if steps:
            s, y = steps[-1]
            d = d * ((s @ y) / (y @ scaled(y)))
        for (s, y), share in zip(steps, reversed(kept)):
            d = d + s * (share - (y @ d) / (s @ y))
        slope, size = float(g @ d), 1.0
        while True:
            new = x + size * d
            f_new, g_new = objective(new)
            if f_new <= f + 1e-4 * size * slope + 1e-15 * abs(f) or size < 1e-10:
                break
            size /= 2
        s, y = new - x, g_new - g
        if s @ y > 1e-14 * np.sqrt((s @ s) * (y @ y)):
            steps = [*steps[1 - MEMORY:], (s, y)]
        x, f, g = new, f_new, g_new
    return x, float(np.abs(g).max()), max_iter


def fit_classifier(
    df: DataFrame, label: str = "label", features: str = "features", weight: str | None = None,
    c: float = 1.0, max_iter: int = 10_000, tol: float = 1e-7,
) -> PipelineModel:
    """Multinomial logistic regression with an L2 penalty of strength ``1/c``.

    Input features in, ``predicted_label`` text out; the label names travel with the model. The
    intercept is not penalised. Features are not rescaled: scaling rare terms by their deviation, as the
    built-in solver does, makes the problem so ill-conditioned that it does not settle. A step is one pass
    over the rows, whose gradients are added up on the executors; the curvature of some rows scales it. The fit ends when no value of the mean
    penalised gradient is above ``tol``; the model carries ``converged``, ``steps`` and ``gradient``.
    """
    indexer = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(df)
    given = indexer.transform(df).withColumn("_w", F.col(weight).cast("double") if weight else F.lit(1.0))
    rows = _sparse(given.select(F.col("_y").alias("y"), F.col("_w").alias("w"), features), features, "y", "w")
    blocks = settle(_blocks(rows), **ROW_GROUPS)
    total, size = blocks.agg(F.sum("total"), F.max("size")).first()
    shape = (len(indexer.labels), size + 1)
    held = np.ones(shape)
    held[:, -1] = 0
    strength = 1.0 / (c * total)

    def objective(flat: np.ndarray) -> tuple[float, np.ndarray]:
        theta = flat.reshape(shape)
        loss, gradient = _gradient(blocks, theta)
        return (loss / total + 0.5 * strength * float((held * theta * theta).sum()),
                (gradient / total + strength * held * theta).ravel())

    flat, gradient, steps = _descend(
        objective, np.zeros(shape[0] * shape[1]), tol, max_iter, _curvature(blocks, total, strength, shape))
    theta = flat.reshape(shape)
    fitted = _as_model(df.sparkSession, theta)
    names = IndexToString(inputCol="_p", outputCol="predicted_label", labels=indexer.labels)
    tidy = SQLTransformer(statement="SELECT * EXCEPT (_p, _prob, _raw) FROM __THIS__")
    model = PipelineModel(stages=[
        fitted.setFeaturesCol(features).setPredictionCol("_p").setProbabilityCol("_prob").setRawPredictionCol("_raw"), names, tidy])
    model.converged, model.steps, model.gradient = gradient <= tol, steps, gradient
    return model


def _as_model(spark: SparkSession, theta: np.ndarray) -> LogisticRegressionModel:
    """Coefficients as a model of the ML library, to be applied and saved like any other."""
    from pyspark.ml.common import _py2java

    context, (classes, width) = spark.sparkContext, theta.shape
    matrix = DenseMatrix(classes, width - 1, theta[:, :-1].ravel(), isTransposed=True)
    java = context._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        f"logreg_{uuid.uuid4().hex[:12]}", _py2java(context, matrix), _py2java(context, Vectors.dense(theta[:, -1])), classes, True)
    return LogisticRegressionModel(java)


def class_names(model: PipelineModel) -> list[str]:
    return next(s for s in model.stages if isinstance(s, IndexToString)).getLabels()


def top_features(features: PipelineModel, model: PipelineModel, value: str, n: int = 40) -> DataFrame:
    """The ``n`` terms with the largest coefficients for one class."""
    spark_model = model.stages[0]
    row = class_names(model).index(value)
    # both sides are as long as the vocabulary, which is capped
    vocabulary = next(s for s in features.stages if hasattr(s, "vocabulary")).vocabulary
    coefficients = spark_model.coefficientMatrix.toArray()[row]
    table = SparkSession.active().createDataFrame(zip(vocabulary, coefficients.tolist()), "term string, coefficient double")
    return table.orderBy(F.desc("coefficient"), "term").limit(n)


def embedding_features(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Precomputed sentence embeddings (an array column) as a feature vector."""
    return df.withColumn("features", array_to_vector(F.col(embedding)))


def score(df: DataFrame, *models: PipelineModel, drop: tuple[str, ...] = ("features",)) -> DataFrame:
    """All rows with ``predicted_label``; nothing is dropped or reordered."""
    for model in models:
        df = model.transform(df)
    return df.drop(*drop)
