"""Packing token sequences by cutting-stock column generation.

A document of n ids is cut into full pieces of ``size`` ids, a sequence each, and a rest. The rests are the stock
problem: their length histogram (lengths in steps of ``step``) goes to a linear program over patterns; a knapsack
dynamic program prices new patterns until none improves it; the rounded patterns are assigned to documents ranked
within each length class. What rounding leaves over, and lengths whose best pattern would waste more than ``waste``, is
laid end to end and cut at sequence ends; the last part of that is cut into powers of two, which need no padding.

Defined cases: a null text is the empty text, whose document is the end id alone; ties within a length class are ranked
by (doc_id, row); repeated rows are separate documents; an empty table gives no rows; further columns are ignored.
The driver holds the histogram (at most size / step classes), the patterns (at most one per class) and one sum per
shuffle bucket, nothing per document.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendlens.llm.bpe import load_ranks, word_encoder
from trendlens.llm.words import char_classes, code_points, distinct_spans, gather, pretoken_starts, slices
from trendlens.session import settle

PIECES = ("doc_id long, row long, doc_tokens long, start long, length long, ids_crc32 long, rest binary")


def token_pieces(docs: DataFrame, ranks: dict[bytes, int], pattern: str, size: int, end_id: int = 0) -> DataFrame:
    """(doc_id, text) to pieces of at most ``size`` ids. ``rest`` holds the ids of a piece shorter than ``size``.

    Each task keeps the ids of the words it has met; a text's ids are put together from them.
    """
    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        row, classes, one = TaskContext.get().partitionId() << 36, char_classes(), word_encoder(ranks, pattern)
        known: dict[bytes, bytes] = {}
        for part in slices(batches):
            ids_of, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
            points, rows = code_points(texts)
            starts = pretoken_starts(points, rows, classes)
            codes, words = distinct_spans(points, starts, "".join(texts).encode())
            if len(known) > 2_000_000:  # memory: the cache starts anew
                known.clear()
            found = []
            for word in words:
                ids = known.get(word)
                if ids is None:
                    ids = known[word] = np.array(one(word), "<u4").tobytes()
                found.append(ids)
            pool = np.frombuffer(b"".join(found), "<u4")
            lengths = np.array([len(x) // 4 for x in found], np.int64)
            flat = gather(pool, (np.cumsum(lengths) - lengths)[codes], lengths[codes]).astype("<u4") if len(codes) else pool
            tokens = np.concatenate([[0], np.cumsum(lengths[codes])]) if len(codes) else np.zeros(1, np.int64)
            edge = tokens[np.searchsorted(starts, rows)]
            out: dict[str, list] = {name: [] for name in ("doc_id", "row", "doc_tokens", "start", "length", "ids_crc32", "rest")}
            end = np.array([end_id], "<u4").tobytes()
            for key, a, b in zip(ids_of, edge[:-1].tolist(), edge[1:].tolist()):
                ids = flat[a:b].tobytes() + end
                total = b - a + 1
                for at in range(0, total, size):
                    piece = ids[4 * at: 4 * (at + size)]
                    for name, value in (("doc_id", key), ("row", row), ("doc_tokens", total), ("start", at),
                                        ("length", len(piece) // 4), ("ids_crc32", zlib.crc32(piece)),
                                        ("rest", piece if len(piece) < 4 * size else None)):
                        out[name].append(value)
                row += 1
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], PIECES).schema)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def patterns(histogram: dict[int, int], capacity: int, tolerance: float = 2e-3,
             rounds: int = 20) -> list[tuple[dict[int, int], int]]:
    """Cutting-stock column generation: ([length: pieces of it], rounded number of sequences).

    Solves min sum(x) with A x = demand over all ways to fill ``capacity``. The basis begins with one pattern per
    length; a knapsack dynamic program finds the pattern of the best price, the simplex step brings it in. Ends within ``tolerance`` of the
    optimum or of no waste at all, or after ``rounds`` steps per length: far less would be won by more.
    """
    lengths = np.array(sorted(n for n, k in histogram.items() if k > 0), np.int64)
    if not len(lengths):
        return []
    m, unit = len(lengths), int(np.gcd.reduce([*lengths, capacity]))
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
    demand = np.array([histogram[int(n)] for n in lengths], float)
    basis = np.diag((capacity // lengths).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    x = np.einsum("ij,j->i", inverse, demand)
    for turn in range(rounds * m):
        if x.sum() * capacity <= (1 + tolerance) * float(lengths @ demand):
            break
        price = inverse.sum(axis=0)  # duals: every pattern costs one
        best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(unit, capacity + 1, unit):
            fits = fitting[room]
            best[room] = best[room - unit]
            if fits:
                value = best[room - lengths[:fits]] + price[:fits]
                k = value.argmax()
                if value[k] > best[room] + 1e-12:
                    best[room], take[room] = value[k], k
        if best[capacity] <= 1 + tolerance:
            break
        column, room = np.zeros(m), capacity
        while room > 0:
            if take[room] < 0:
                room -= unit
            else:
                column[take[room]] += 1
                room -= int(lengths[take[room]])
        step = np.einsum("ij,j->i", inverse, column)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        inverse[out] /= step[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(step[others], inverse[out])
        if turn % 50 == 49:
            inverse = np.linalg.inv(basis)
        x = np.maximum(np.einsum("ij,j->i", inverse, demand), 0)
    left, made = demand.astype(np.int64), []
    for j in np.argsort(-x):
        counts = basis[:, j].astype(np.int64)
        used = counts > 0
        copies = int(min(np.floor(x[j] + 1e-7), (left[used] // counts[used]).min()))
        if copies > 0:
            left -= counts * copies
            made.append(({int(lengths[i]): int(counts[i]) for i in np.flatnonzero(used)}, copies))
    return made


def pack(pieces: DataFrame, size: int, step: int = 8, waste: float = 0.01) -> DataFrame:
    """Assign ``token_pieces`` to sequences: adds sequence_id and offset, cuts some rests once more.

    ``pieces`` must be settled: it is read several times.
    """
    spark = pieces.sparkSession
    full = pieces.where(F.col("length") == size)
    rests = pieces.where(F.col("length") < size).withColumn("class", F.ceil(F.col("length") / step) * step)
    narrow = rests.select("doc_id", "row", "length", "class")

    # Rank within the class: counts per (class, bucket) give offsets, buckets are ranked by themselves.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pieces.rdd.getNumPartitions())
    dealt = narrow.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    counts = settle(dealt.groupBy("class", "bucket").count())
    histogram = {int(r["class"]): int(r["n"]) for r in counts.groupBy("class").agg(F.sum("count").alias("n")).collect()}
    made = [(p, n) for p, n in patterns(histogram, size) if sum(c * k for c, k in p.items()) >= (1 - waste) * size]
    before = F.coalesce(F.sum("count").over(Window.partitionBy("class").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("class", "bucket", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("class", "bucket").orderBy("doc_id", "row")) - 1
    ranked = dealt.withColumn("within", within).join(offsets, ["class", "bucket"]).withColumn(
        "rank", F.col("before") + F.col("within")).select("row", "length", "class", "rank")

    n_full = full.count()
    slots, taken, base = [], {}, n_full
    for counts_of, copies in made:
        slot = 0
        for length, k in counts_of.items():
            a = taken.get(length, 0)
            slots.append((length, a, a + k * copies, k, base, slot))
            taken[length] = a + k * copies
            slot += k
        base += copies
    slots_df = spark.createDataFrame(
        slots,
        "class long, first long, last long, each long, base long, slot long")  # at most classes x kinds in a pattern
    placed = ranked.join(F.broadcast(slots_df), "class").where("rank >= first and rank < last").select(
        "row", "length", (F.col("base") + F.expr("(rank - first) div each")).alias("sequence_id"),
        (F.col("slot") + (F.col("rank") - F.col("first")) % F.col("each")).alias("slot"))
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("row", "sequence_id", F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"))

    done = settle(rests.drop("class").join(placed, "row").drop("rest"))
    used = spark.createDataFrame(list(taken.items()) or [(-1, 0)], "class long, used long")
    over = ranked.join(F.broadcast(used), "class", "left").where("rank >= coalesce(used, 0)").select("row", "class", "rank")
    left = settle(rests.drop("class").join(over.drop("class", "rank"), "row"))
    out = done.unionByName(_lay_out(left, size, base, buckets))
    placed_full = _running(full.drop("rest").withColumn("one", F.lit(1).cast("long")), "one", buckets)[0]
    return out.unionByName(placed_full.withColumns({
        "sequence_id": F.col("begin"), "offset": F.lit(0).cast("long")}).drop("begin", "one"))


def _running(rows: DataFrame, amount: str, buckets: int) -> tuple[DataFrame, int]:
    """Add ``begin``, the sum of ``amount`` over all rows before, and give the total; no sort over all rows."""
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("row", "start"), F.lit(buckets)))
    sums = sorted((r["bucket"], r["n"]) for r in dealt.groupBy("bucket").agg(F.sum(amount).alias("n")).collect())
    offsets, total = [], 0
    for bucket, n in sums:  # one entry per bucket
        offsets.append((bucket, total))
        total += n
    table = F.broadcast(rows.sparkSession.createDataFrame(offsets, "bucket long, before long"))
    earlier = Window.partitionBy("bucket").orderBy("row", "start").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("within", F.coalesce(F.sum(amount).over(earlier), F.lit(0))).join(table, "bucket")
    return placed.withColumn("begin", F.col("before") + F.col("within")).drop("bucket", "before", "within"), total


def _lay_out(left: DataFrame, size: int, base: int, buckets: int) -> DataFrame:
    """Rests end to end, cut at sequence ends. The last, short part is cut into falling powers of two."""
    laid, total = _running(left, "length", buckets)
    whole = total // size
    tail, at = [], whole * size
    for bit in range(size.bit_length() - 1, -1, -1):
        if (total - at) >> bit:
            tail.append((at, at + (1 << bit)))
            at += 1 << bit

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            out: list[dict] = []
            for r in batch.to_pylist():
                at, stop = r["begin"], r["begin"] + r["length"]
                while at < stop:
                    if at < whole * size:
                        number, first, last = at // size, at // size * size, at // size * size + size
                    else:
                        k = next(i for i, (a, b) in enumerate(tail) if a <= at < b)
                        number, (first, last) = whole + k, tail[k]
                    a, b = at - r["begin"], min(last, stop) - r["begin"]
                    out.append({"doc_id": r["doc_id"], "row": r["row"], "doc_tokens": r["doc_tokens"],
                                "start": r["start"] + a, "length": b - a, "ids_crc32": zlib.crc32(r["rest"][4 * a: 4 * b]),
                                "sequence_id": base + number, "offset": at - first})
                    at = min(last, stop)
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    kind = "row long, doc_id long, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long"
    schema = to_arrow_schema(left.sparkSession.createDataFrame([], kind).schema)
    return laid.mapInArrow(cut, kind)


def pack_documents(docs: DataFrame, size: int = 1024, step: int = 8, waste: float = 0.01) -> DataFrame:
    """All documents to pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    import public_tokenizers

    # byte_bpe_50k.tiktoken holds the vocabulary of byte_bpe_50k.json as ranks; ids are the same (tested).
    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    pieces = settle(token_pieces(docs, ranks, public_tokenizers.PATTERN, size))
    packed = pack(pieces, size, step, waste)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 1024 ids."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
