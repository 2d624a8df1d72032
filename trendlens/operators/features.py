"""Term counts and tf-idf weights as plain tables."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trendlens.functions.text import ngrams, tokens
from trendlens.operators.ranking import with_position
from trendlens.session import attach_small, settle

MAX_FEATURES = 80_000  # fixed value: vocabulary cap, the bound on what is broadcast below
MAX_DF = 0.98  # fixed value
NGRAM_RANGE = (1, 3)  # fixed value


def _counted(words: list[str] | None, lo: int, hi: int) -> Counter:
    """A row's n-grams with their counts."""
    found: Counter = Counter()
    for n in range(lo, hi + 1):
        found.update(map(" ".join, zip(*[(words or [])[i:] for i in range(n)])))
    return found


def _by_row(df: DataFrame, doc: str | None, text: str, ngram_range: tuple[int, int], idf: dict[str, float] | None = None) -> DataFrame:
    """(doc, term, tf), each row counted where it is; with ``idf`` its terms only, and ``weight`` scaled to unit length."""
    lo, hi = ngram_range
    rows = df.select(*([doc] if doc else []), tokens(F.col(text)).alias("_words"))
    out = StructType([f for f in rows.schema if f.name == doc]).add("term", "string").add("tf", "long")
    out = out.add("weight", "double") if idf is not None else out

    def count(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 32):  # so few rows are Python objects at a time
                part = batch.slice(at, 32)
                sizes, terms, tfs, weights = [], [], [], []
                for words in part.column("_words").to_pylist():
                    found = _counted(words, lo, hi)
                    if idf is not None:
                        found = {t: n for t, n in found.items() if t in idf}
                        raw = np.array([n * idf[t] for t, n in found.items()])
                        weights.append(raw / np.sqrt(raw @ raw) if len(raw) else raw)
                    sizes.append(len(found))
                    terms += found.keys()
                    tfs += found.values()
                columns = {"term": pa.array(terms, pa.string()), "tf": pa.array(tfs, pa.int64())}
                if doc:
                    columns = {doc: part.column(doc).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))} | columns
                if idf is not None:
                    columns["weight"] = pa.array(np.concatenate(weights), pa.float64())
                yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(count, out)


def _single(df: DataFrame, doc: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows that have their document id alone, and the others (null ids among them), if there are any."""
    more = settle(df.groupBy(doc).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > 1) | F.col(doc).isNull()).select(doc))
    if more.isEmpty():
        return df, None
    known = df.filter(F.col(doc).isNotNull())
    shared = attach_small(known, more, [doc], "left_semi").unionByName(df.filter(F.col(doc).isNull()))
    return attach_small(known, more, [doc], "left_anti"), shared


def _by_document(df: DataFrame, doc: str, text: str, ngram_range: tuple[int, int]) -> DataFrame:
    """(doc, term, tf) where several rows may be one document: their terms meet in a shuffle."""
    words = df.select(doc, tokens(F.col(text)).alias("_words"))
    lo, hi = ngram_range
    grams = F.concat(*[ngrams(F.col("_words"), n) for n in range(lo, hi + 1)])
    return words.select(doc, F.explode(grams).alias("term")).groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))


def term_counts(df: DataFrame, doc: str, text: str, ngram_range: tuple[int, int] = NGRAM_RANGE) -> DataFrame:
    """(doc, term, tf). A document that is one row is counted in its own map task; only ids of several rows are shuffled."""
    return _counts(*_single(df, doc), doc, text, ngram_range)


def _counts(alone: DataFrame, shared: DataFrame | None, doc: str, text: str, ngram_range: tuple[int, int]) -> DataFrame:
    counts = _by_row(alone, doc, text, ngram_range)
    return counts if shared is None else counts.unionByName(_by_document(shared, doc, text, ngram_range))


def row_term_counts(df: DataFrame, text: str, ngram_range: tuple[int, int] = NGRAM_RANGE) -> DataFrame:
    """(term, tf) of every row, each a document of its own."""
    return _by_row(df, None, text, ngram_range)


def vocabulary(
    counts: DataFrame, n_docs, max_features: int = MAX_FEATURES, min_df: int = 1, max_df: float = MAX_DF
) -> DataFrame:
    """(term, cf, df) of the most frequent terms; ties at the cap go by term.

    A histogram of the frequencies tells at which one the cap falls. Terms above it are taken as they are; only those at
    it are sorted. ``n_docs`` is a column, usually a scalar subquery.
    """
    terms = counts.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))
    return _most_frequent(settle(terms.filter(_allowed(n_docs, min_df, max_df))), max_features)


def _allowed(n_docs, min_df: int, max_df: float) -> Column:
    return (F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n_docs)


def _edge(kept: DataFrame, max_features: int) -> Row | None:
    """The frequency at which the cap falls, with the numbers of terms at it and down to it; none below the cap."""
    sizes = kept.groupBy("cf").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.orderBy(F.desc("cf")))  # one short row per distinct frequency
    return sizes.withColumn("upto", upto).filter(F.col("upto") >= max_features).orderBy("upto").first()


def _most_frequent(kept: DataFrame, max_features: int) -> DataFrame:
    edge = _edge(kept, max_features)
    if edge is None:
        return kept
    left = max_features - (edge["upto"] - edge["n"])
    tied = with_position(kept.filter(F.col("cf") == edge["cf"]), ["term"], "_place")  # a distributed sort: no task takes the top of all
    return kept.filter(F.col("cf") > edge["cf"]).unionByName(tied.filter(F.col("_place") < left).drop("_place"))


CHUNK_WORDS = 1 << 20  # words counted together before they are shuffled
BLOCK_WORDS = 1 << 16  # words in a stored row
MAX_WORDS = 1 << 20  # numbered words, looked up where the texts are; three numbers fit into one long
MAX_PAIRS = 1 << 21  # word pairs looked up where trigrams are counted
UNKNOWN, END = -1, -2  # in place of a word's number; END after each row


def _chunks(batches, column: str, sizes, most: int):
    """Values of a column, as many together as make up ``most``, or one."""
    held, total = [], 0
    for batch in batches:
        values, start = batch.column(column), 0
        for at, n in enumerate(sizes(values).tolist()):
            if total and total + n > most:
                yield pa.concat_arrays([*held, values.slice(start, at - start)])
                held, total, start = [], 0, at
            total += n
        held.append(values.slice(start))
    if held:
        yield pa.concat_arrays(held)


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy()


def _tally(of: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, how often each comes, and in how many rows."""
    values, at = np.unique(of, return_inverse=True)
    rows = int(row[-1]) + 1 if len(row) else 1
    pairs = np.unique(at * rows + row)
    return values, np.bincount(at, minlength=len(values)), np.bincount(pairs // rows, minlength=len(values))


def _word_counts(words: DataFrame) -> DataFrame:
    """(term, cf, df) of single words, counted in chunks where they are read."""

    def count(batches):
        for lists in _chunks(batches, "_words", _lengths, CHUNK_WORDS):
            coded = lists.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(lists)), _lengths(lists))
            at, cf, df = _tally(coded.indices.to_numpy().astype(np.int64), row)
            yield pa.RecordBatch.from_pydict({
                "term": coded.dictionary.take(pa.array(at)), "cf": pa.array(cf, pa.int64()), "df": pa.array(df, pa.int64())})

    return _added(words.mapInArrow(count, "term string, cf long, df long"), "term")


def _added(parts: DataFrame, by: str) -> DataFrame:
    return parts.groupBy(by).agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def _numbered(words: DataFrame, known: pa.Array) -> DataFrame:
    """The rows' words as numbers, blocks of rows in one value."""

    def number(batches):
        for lists in _chunks(batches, "_words", _lengths, CHUNK_WORDS):
            found = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), UNKNOWN).to_numpy()
            ids = np.insert(found, np.cumsum(_lengths(lists)), END).astype(np.int32)
            ends = np.flatnonzero(ids == END) + 1
            cuts = ends[np.flatnonzero(np.diff(ends // BLOCK_WORDS, prepend=0))]
            parts = [part.tobytes() for part in np.split(ids, cuts) if len(part)]
            yield pa.RecordBatch.from_pydict({"ids": pa.array(parts, pa.binary())})

    return words.mapInArrow(number, "ids binary")


def _gram_counts(blocks: DataFrame, n: int, base: int, among: np.ndarray | None = None) -> DataFrame:
    """(code, cf, df) of n-grams of numbered words, the first number highest. ``among``: the n-grams one shorter that are looked at, sorted."""

    def count(batches):
        for held in _chunks(batches, "ids", lambda v: pc.binary_length(v).to_numpy() // 4, CHUNK_WORDS):
            ids = np.concatenate([np.frombuffer(v.as_buffer(), np.int32) for v in held]).astype(np.int64)
            row = np.cumsum(ids == END)
            size = max(len(ids) - n + 1, 0)
            code, full = np.zeros(size, np.int64), np.ones(size, bool)
            for k in range(n):
                code, full = code * base + ids[k: k + size], full & (ids[k: k + size] >= 0)
            if among is not None:
                for part in (code // base, code % base ** (n - 1)):
                    full &= np.isin(part, among, kind="sort")
            values, cf, df = _tally(code[full], row[:size][full])
            yield pa.RecordBatch.from_pydict({"code": values, "cf": pa.array(cf, pa.int64()), "df": pa.array(df, pa.int64())})

    return _added(blocks.mapInArrow(count, "code long, cf long, df long"), "code")


def _spelt(counts: DataFrame, n: int, known: pa.Array) -> DataFrame:
    """(term, cf, df) for codes of n-grams."""
    base = len(known)

    def spell(batches):
        for batch in batches:
            code, parts = batch.column("code").to_numpy(), []
            for _ in range(n):
                parts.insert(0, known.take(pa.array(code % base)))
                code = code // base
            term = pc.binary_join_element_wise(*parts, " ")
            yield pa.RecordBatch.from_pydict({"term": term, "cf": batch.column("cf"), "df": batch.column("df")})

    return counts.mapInArrow(spell, "term string, cf long, df long")


def row_vocabulary(
    df: DataFrame, text: str, n_docs, max_features: int = MAX_FEATURES, min_df: int = 1, max_df: float = MAX_DF
) -> DataFrame:
    """The ``vocabulary`` of rows that are a document each.

    An n-gram is no more frequent than the n-grams in it. So words are counted first, and pairs only of words that are as
    frequent as the cap asks among words; trigrams only of pairs as frequent as it asks among words and pairs. Words are
    numbers by then. With too many such words for that, all n-grams are counted as texts.
    """
    allowed = _allowed(n_docs, min_df, max_df)
    words = df.select(tokens(F.col(text)).alias("_words"))
    counted = settle(_word_counts(words).filter(F.col("df") >= min_df))
    edge = _edge(counted.filter(allowed), max_features)
    counted = counted.filter(F.col("cf") >= (edge["cf"] if edge else 1))
    if counted.count() > MAX_WORDS:
        return vocabulary(row_term_counts(df, text), n_docs, max_features, min_df, max_df)
    known = pa.array(counted.select("term").toArrow().column("term").to_pylist(), pa.string())
    blocks, found, among = settle(_numbered(words, known)), counted.filter(allowed), None
    for n in range(2, NGRAM_RANGE[1] + 1):
        enough = (F.col("cf") >= (edge["cf"] if edge else 1)) & (F.col("df") >= min_df)
        grams = settle(_gram_counts(blocks, n, max(len(known), 1), among).filter(enough))
        found = settle(found.unionByName(_spelt(grams.filter(allowed), n, known)))
        if n < NGRAM_RANGE[1]:
            edge = _edge(found, max_features)
            grams = grams.filter(F.col("cf") >= (edge["cf"] if edge else 1))
            among = np.sort(grams.select("code").toArrow().column("code").to_numpy()) if grams.count() <= MAX_PAIRS else None
    return _most_frequent(found, max_features)


def tfidf(
    df: DataFrame, doc: str, text: str, ngram_range: tuple[int, int] = NGRAM_RANGE,
    max_features: int = MAX_FEATURES, min_df: int = 1, max_df: float = MAX_DF,
) -> DataFrame:
    """(doc, term, tf, weight): tf · (ln((1+n)/(1+df)) + 1), scaled to unit length per document."""
    n_docs = df.agg(F.count(F.lit(1))).scalar()
    alone, shared = _single(df, doc)
    vocab = settle(vocabulary(_counts(alone, shared, doc, text, ngram_range), n_docs, max_features, min_df, max_df))
    idf = vocab.select("term", (F.log((n_docs + 1) / (F.col("df") + 1)) + 1).alias("_idf"))
    # at most max_features rows, so terms are looked up where the texts are
    known = idf.toArrow()
    weights = dict(zip(known.column("term").to_pylist(), known.column("_idf").to_pylist()))
    done = _by_row(alone, doc, text, ngram_range, weights)
    if shared is None:
        return done
    raw = _by_document(shared, doc, text, ngram_range).join(F.broadcast(idf), "term").withColumn("_raw", F.col("tf") * F.col("_idf"))
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(W.partitionBy(doc)))
    return done.unionByName(raw.select(doc, "term", "tf", (F.col("_raw") / norm).alias("weight")))
