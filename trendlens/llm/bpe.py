"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are cut into pre-tokens. A block of some megabytes of text sends its distinct words to buckets by word hash and
keeps the word codes of all its positions; a bucket encodes each distinct word once; the ids go back to the block, which
puts the documents together again by position. Positions travel once and words once per block, so a word that is a
third of all tokens is no more work than another.

Defined cases: a null text is the empty text and has no ids; an empty table gives no rows; repeated rows are encoded one
by one; the key column may hold nulls; other columns are not looked at. A text longer than a block is a block of its own.
``docs`` has to come from files or a settled table, so that a task that is run again cuts the same blocks.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlens.llm.words import char_classes, code_points, distinct_spans, gather, pretoken_starts, slices

STREAM = "key long, block long, bucket int, keys binary, sizes binary, body binary"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def word_encoder(ranks: dict[bytes, int], pattern: str):
    """A function from the bytes of one pre-token to its ids."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


def _press(a) -> bytes:
    return zstandard.compress(bytes(a), 1)


def _press_numbers(a: np.ndarray) -> bytes:
    """The bytes of the numbers, all lowest bytes first: that presses better."""
    return _press(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T))


def _numbers(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, text) to (key, n_tokens, ids): ids as little-endian unsigned 32-bit integers."""
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())

    def cut(batches):
        from pyspark import TaskContext

        task, count, classes = TaskContext.get().partitionId(), 0, char_classes()
        for part in slices(batches):
            block = (task << 32) + count
            count += 1
            keys, texts = part.column(0), [t or "" for t in part.column(1).to_pylist()]
            points, rows = code_points(texts)
            starts = pretoken_starts(points, rows, classes)
            codes, found = distinct_spans(points, starts, "".join(texts).encode())
            per_row = np.diff(np.searchsorted(starts, rows))
            bucket = np.array([zlib.crc32(w) % buckets for w in found], np.int64)
            order = np.argsort(bucket, kind="stable")
            renamed = np.empty(len(order), np.int64)
            renamed[order] = np.arange(len(order))
            words = [found[i] for i in order.tolist()]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("k", keys.type)])) as out:
                out.write_batch(pa.record_batch([keys], names=["k"]))
            out = {"key": [block], "block": [block], "bucket": [-1], "keys": [_press(sink.getvalue())],
                   "sizes": [_press_numbers(per_row)],
                   "body": [_press_numbers(renamed[codes] if len(codes) else codes)]}
            edges = np.flatnonzero(np.diff(np.concatenate([[-1], bucket[order]])))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)]):
                w, k = words[a:b], int(bucket[order[a]])
                for name, value in (("key", -1 - k), ("block", block), ("bucket", k), ("keys", None),
                                    ("sizes", _press_numbers(np.array([len(x) for x in w]))), ("body", _press(b"".join(w)))):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    def encode_bucket(key, table):
        if key[0].as_py() >= 0:
            return empty
        one, known = word_encoder(ranks, pattern), {}
        out = {name: [] for name in schema.names}
        for row in table.select(["block", "bucket", "sizes", "body"]).to_pylist():
            ends, body = np.cumsum(_numbers(row["sizes"])), zstandard.decompress(row["body"])
            found = []
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
                word = body[a:b]
                ids = known.get(word)
                if ids is None:
                    ids = known[word] = np.array(one(word), "<u4").tobytes()
                found.append(ids)
            for name, value in (("key", row["block"]), ("block", row["block"]), ("bucket", row["bucket"]), ("keys", None),
                                ("sizes", _press_numbers(np.array([len(x) // 4 for x in found]))),
                                ("body", _press_numbers(np.frombuffer(b"".join(found), "<u4")))):
                out[name].append(value)
        return pa.Table.from_pydict(out, schema=schema)

    def put_together(key, positions, words):
        if key[0].as_py() < 0:
            return none
        given = {r["bucket"]: r for r in words.select(["bucket", "sizes", "body"]).to_pylist()}
        lengths = np.concatenate([np.zeros(0, np.int64), *(_numbers(given[b]["sizes"]).astype(np.int64) for b in sorted(given))])
        ids = np.concatenate([np.zeros(0, np.uint32), *(_numbers(given[b]["body"]) for b in sorted(given))])
        begin = np.cumsum(lengths) - lengths
        (row,) = positions.select(["keys", "sizes", "body"]).to_pylist()
        codes, per_row = _numbers(row["body"]).astype(np.int64), _numbers(row["sizes"]).astype(np.int64)
        flat = gather(ids, begin[codes], lengths[codes]).astype("<u4")
        tokens = np.concatenate([[0], np.cumsum(lengths[codes])])
        edge = tokens[np.concatenate([[0], np.cumsum(per_row)])]
        with pa.ipc.open_stream(zstandard.decompress(row["keys"])) as stream:
            keys = stream.read_all().column(0).combine_chunks()
        data = pa.py_buffer(flat)
        packed = pa.Array.from_buffers(pa.large_binary(), len(edge) - 1, [None, pa.py_buffer((edge * 4).astype(np.int64)), data])
        return pa.Table.from_arrays([keys, pa.array(np.diff(edge)), packed.cast(pa.binary())], schema=result)

    from pyspark.sql.pandas.types import to_arrow_schema

    base = docs.select(key, "text")
    schema = to_arrow_schema(spark.createDataFrame([], STREAM).schema)
    out_type = docs.select(key, F.lit(0).cast("long").alias("n_tokens"), F.lit(b"").alias("ids")).schema
    result = pa.schema([pa.field(f.name, f.type) for f in to_arrow_schema(out_type)])
    empty, none = schema.empty_table(), result.empty_table()
    stream = base.mapInArrow(cut, STREAM)
    encoded = stream.groupBy("key").applyInArrow(encode_bucket, STREAM)
    return stream.groupBy("key").cogroup(encoded.groupBy("key")).applyInArrow(put_together, out_type)


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Add ``decoded``: the bytes of the ids, joined from the table of token bytes. An id without bytes is an error."""
    def join_bytes(batches):
        size = max(ranks.values(), default=-1) + 1
        lengths = np.full(size, -1, np.int64)
        lengths[list(ranks.values())] = [len(t) for t in ranks]
        begin = np.zeros(size, np.int64)
        tokens = list(ranks)
        begin[list(ranks.values())] = np.concatenate([[0], np.cumsum([len(t) for t in tokens])[:-1]]) if tokens else []
        pool = np.frombuffer(b"".join(tokens), np.uint8)
        for part in slices(batches, "ids", 4 << 20):
            ids = part.column(part.schema.get_field_index("ids"))
            texts = ids.to_pylist()
            flat = np.frombuffer(b"".join(t or b"" for t in texts), "<u4").astype(np.int64)
            if len(flat) and (flat.max() >= size or lengths[flat].min() < 0):
                raise ValueError("an id that is not in the table")
            size_of = np.concatenate([[0], np.cumsum(lengths[flat])])
            edge = size_of[np.concatenate([[0], np.cumsum([len(t or b"") // 4 for t in texts])])].astype(np.int64)
            out = gather(pool, begin[flat], lengths[flat])
            packed = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(edge), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([*part.columns, packed.cast(pa.binary())], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(join_bytes, encoded.withColumn("decoded", F.lit(b"")).schema)


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    """Encode and decode all documents and give digests of both."""
    import public_tokenizers

    ranks = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = decode(encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
