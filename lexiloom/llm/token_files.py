"""Token ids in shards of separately compressed documents with a shared zstandard dictionary.

A shard is one binary value: a header, an index (document id, place of its frame, number of ids) and one
zstandard frame per document over its little-endian ids.  Every frame is compressed by itself with one
dictionary that was trained on serialized id arrays, so a short document costs a short frame and is read by
one look-up in the index.  The header names the dictionary by its hash; a reader refuses another one.

Shards are the rows of a Parquet table (``bucket``, ``seq``, ``first_id``, ``last_id``, ``docs``, ``tokens``,
``blob``), so Spark's committer writes them and row-group statistics find a document's shard.  Buckets are
ranges of ids, shards within a bucket are numbered in id order, and so are documents within a shard.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_rows, materialize, texts
from .encoding import encoder, share_file, tokenizer_file

MAGIC = b"IDSHARD1"
HEADER = "<8s32sBQ"  # magic, sha256 of the dictionary, bytes per id, documents
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("size", "<u8"), ("tokens", "<u8")])
SHARDS = "bucket long, seq long, first_id long, last_id long, docs long, tokens long, blob binary"


def train_dictionary(
    docs: DataFrame, definition: Broadcast, spaces: str, end_id: int,
    sample_docs: int = 1000, sample_bytes: int = 32_768, size: int = 65_536,
) -> bytes:
    """zstandard dictionary over the serialized ids of a bounded sample of documents.

    The sample is the ``sample_docs`` documents of smallest hashed id among those of at most ``sample_bytes``
    bytes, so the driver sees 32 MB of text at most.  A sample too small to train on gives an empty dictionary.
    """
    import zstandard

    order = F.xxhash64("doc_id"), "doc_id"
    ids = docs.filter(F.octet_length("text") <= sample_bytes).select("doc_id").orderBy(*order).limit(sample_docs)
    sample = (
        docs.filter(F.octet_length("text") <= sample_bytes).join(F.broadcast(ids.distinct()), "doc_id", "left_semi")
        .orderBy(*order).limit(sample_docs)
    )
    rows = [r[0] for r in encode(sample, definition, spaces, end_id).select("ids").collect()]
    if sum(map(len, rows)) < 8 * size:
        size = max(256, sum(map(len, rows)) // 8)
    try:
        return zstandard.train_dictionary(size, rows).as_bytes()
    except zstandard.ZstdError:
        return b""


def encode(docs: DataFrame, definition: Broadcast, spaces: str, end_id: int) -> DataFrame:
    """Serialized ids of whole texts, the end id last: doc_id, ids (two bytes each, four if the end id needs them)."""
    width = "<u2" if end_id < 65_536 else "<u4"
    end = np.array([end_id], width).tobytes()

    def rows(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            ids = encoder(definition, spaces).encode(b.column("text"))
            yield [b.column("doc_id"), [narrow(x.as_buffer(), width) + end for x in ids]]

    return map_rows(docs.select("doc_id", "text"), rows, "doc_id long, ids binary")


def narrow(ids, width: str) -> bytes:
    a = np.frombuffer(ids, "<u4")
    if width == "<u2" and a.size and a.max() > 65_535:
        raise ValueError("an id needs more than two bytes")
    return a.astype(width).tobytes()


def compressor(dictionary: bytes, cls: str):
    import zstandard

    return getattr(zstandard, cls)(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))


def pack_shard(rows: list[tuple[int, int, bytes]], digest: bytes, width: int) -> bytes:
    """rows: doc_id, number of ids, frame."""
    index = np.zeros(len(rows), INDEX)
    index["doc_id"] = [r[0] for r in rows]
    index["tokens"] = [r[1] for r in rows]
    index["size"] = [len(r[2]) for r in rows]
    index["offset"] = np.cumsum(index["size"]) - index["size"]
    return struct.pack(HEADER, MAGIC, digest, width, len(rows)) + index.tobytes() + b"".join(r[2] for r in rows)


def open_shard(blob: bytes, dictionary: bytes) -> tuple[np.ndarray, memoryview, str]:
    """Index and frames of a shard; one document is ``frames[offset:offset + size]``."""
    magic, digest, width, n = struct.unpack_from(HEADER, blob)
    if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
        raise ValueError("not a shard of this dictionary")
    start = struct.calcsize(HEADER) + n * INDEX.itemsize
    return np.frombuffer(blob, INDEX, n, struct.calcsize(HEADER)), memoryview(blob)[start:], f"<u{width}"


def write_shards(
    docs: DataFrame, end_id: int = 1, tokenizer: str | None = None, spaces: str = "dropped",
    bucket_docs: int = 4096, shard_bytes: int = 4 << 20,
) -> tuple[DataFrame, bytes]:
    """Shards of all documents (doc_id, text) in ascending id order, and the dictionary they are compressed with.

    Null text is empty; an empty text has the end id alone.  Null ids come first.  Rows that share an id are
    all kept, in any order among themselves, and are spread over as many buckets as their number asks for.
    Other columns are ignored; an empty table gives no shards.  ``spaces``: see ``PieceEncoder``.
    """
    spark = docs.sparkSession
    docs = texts(docs)
    definition = share_file(spark, tokenizer_file(tokenizer, "word_bpe_49k.json"))
    dictionary = train_dictionary(docs, definition, spaces, end_id)
    digest, width = hashlib.sha256(dictionary).digest(), 2 if end_id < 65_536 else 4
    n = docs.count()
    buckets = max(1, -(-n // bucket_docs))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10 * buckets + 1000)).first()[0] if buckets > 1 else []
    bounds = spark.sparkContext.broadcast(np.array(cuts or [], np.int64))

    def compress(batches: Iterator[pa.RecordBatch]):
        c = compressor(dictionary, "ZstdCompressor")
        salt = 0
        for b in batches:
            ids = [i if i is not None else None for i in b.column("doc_id").to_pylist()]
            key = np.array([-(2**63) if i is None else i for i in ids], np.int64)
            low, high = np.searchsorted(bounds.value, key, "left"), np.searchsorted(bounds.value, key, "right")
            bucket = low + (salt + np.arange(len(key))) % (high - low + 1)  # equal ids may fill several buckets
            salt += len(key)
            raw = b.column("ids").to_pylist()
            yield [bucket, ids, [len(x) // width for x in raw], [c.compress(x) for x in raw]]

    frames = map_rows(encode(docs, definition, spaces, end_id), compress, "bucket long, doc_id long, tokens long, frame binary")
    ordered = frames.repartition("bucket").sortWithinPartitions("bucket", "doc_id")

    def shards(batches: Iterator[pa.RecordBatch]):
        held, size, bucket, seq = [], 0, None, 0

        def done():
            ids = [r[0] for r in held]
            rows = [(-(2**63) if i is None else i, n, f) for i, n, f in held]
            return [[bucket], [seq], [ids[0]], [ids[-1]], [len(held)], [sum(r[1] for r in held)], [pack_shard(rows, digest, width)]]

        for b in batches:
            for k, i, n, f in zip(*(c.to_pylist() for c in b.columns)):
                if held and (k != bucket or size + len(f) > shard_bytes):
                    yield done()
                    seq, held, size = 0 if k != bucket else seq + 1, [], 0
                bucket = k
                held.append((i, n, f))
                size += len(f)
        if held:
            yield done()

    return map_rows(ordered, shards, SHARDS), dictionary


def read_shards(shards: DataFrame, dictionary: bytes) -> DataFrame:
    """Documents of shards: doc_id, start (ids of all documents before it), n_tokens, ids.

    Starts are running sums in three steps: over buckets, over the shards of a bucket, and within a shard.
    """
    sums = shards.groupBy("bucket").agg(F.sum("tokens").alias("t"))
    before = sums.select("bucket", (F.sum("t").over(Window.orderBy("bucket")) - F.col("t")).alias("before"))
    within = F.sum("tokens").over(Window.partitionBy("bucket").orderBy("seq")) - F.col("tokens")
    placed = shards.select("bucket", "seq", within.alias("within")).join(before, "bucket")
    starts = placed.select("bucket", "seq", (F.col("before") + F.col("within")).alias("start"))

    def rows(batches: Iterator[pa.RecordBatch]):
        d = compressor(dictionary, "ZstdDecompressor")
        for b in batches:
            for blob, start in zip(b.column("blob"), b.column("start").to_pylist()):
                index, frames, width = open_shard(blob.as_buffer().to_pybytes(), dictionary)
                starts = start + np.cumsum(index["tokens"]) - index["tokens"]
                for i in range(0, len(index), 1024):
                    part = index[i : i + 1024]
                    yield [
                        [None if k == -(2**63) else k for k in part["doc_id"].tolist()],
                        starts[i : i + 1024].astype(np.int64), part["tokens"].astype(np.int64),
                        [np.frombuffer(d.decompress(frames[o : o + s]), width).astype("<u4").tobytes() for o, s in zip(part["offset"].tolist(), part["size"].tolist())],
                    ]

    return map_rows(shards.select("bucket", "seq", "blob").join(starts, ["bucket", "seq"]).select("start", "blob"), rows,
                    "doc_id long, start long, n_tokens long, ids binary")


def find_document(shards: DataFrame, dictionary: bytes, doc_id: int) -> list[np.ndarray]:
    """Ids of every row of one document, from the shards whose id range holds it."""
    out = []
    for row in shards.filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).select("blob").toLocalIterator():
        index, frames, width = open_shard(bytes(row[0]), dictionary)
        for e in index[index["doc_id"] == doc_id]:
            o, s = int(e["offset"]), int(e["size"])
            out.append(np.frombuffer(compressor(dictionary, "ZstdDecompressor").decompress(frames[o : o + s]), width))
    return out


def token_digests(docs: DataFrame, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """Write the shards, read them back, and describe each document's ids."""
    shards, dictionary = write_shards(docs, end_id, tokenizer)
    back = read_shards(materialize(shards, "id-shards"), dictionary)
    return back.select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"),
        F.lit(hashlib.sha256(dictionary).hexdigest()).alias("dictionary_sha256"),
    )
