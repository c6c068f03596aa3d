"""Token ids as binary shards in training order.

Every document's ids, with an end mark, are cut into sequences of equal length. A sequence's index is
(document id - least id) * most sequences of a document + its number in the document; a keyed Feistel network with
cycle-walking permutes the range of all indices. The places so found give the training order: the slot of a sequence is
the rank of its place. Places are spread evenly, so equal ranges of places are balanced partitions without sampling, and
no numbering of documents, no second tokenisation and no join are needed. Each range is sorted by place and written as
one shard of records of one fixed size, by Spark's own writer; the slot of a record is its shard's first slot plus
its offset divided by that size, so a reader can start at any slot.

Record: document id, number in the document and number of ids (big-endian, 8, 4 and 4 bytes), ids (little-endian, two
bytes each, padded), line feed.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LENGTH = 512
SHARD_BYTES = 64 << 20
HEADER = 16
ROUNDS = 6
NO_ID = -(2**63)


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level vocabulary: ranks as in its file, the pattern that cuts texts, and the id that ends documents."""

    ranks: bytes
    pattern: str
    end: int

    def encoder(self) -> tiktoken.Encoding:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, self.ranks.splitlines())}
        return tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})


def read_vocabulary(path: str, pattern: str, end: int) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary(f.read(), pattern, end)


def mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed 64-bit mixing function."""
    x = x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed permutation of range(size): a balanced Feistel network over the next even number of bits, applied
    again to each value that lies outside until it lies inside (cycle-walking)."""
    half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> half, out[todo] & mask
            for r in range(ROUNDS):
                left, right = right, left ^ (mixed(right, key + r * 0x9E3779B97F4A7C15) & mask)
            out[todo] = (left << half) | right
            todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


def stride(length: int) -> int:
    return HEADER + 2 * length + 1


@dataclass(frozen=True)
class Layout:
    """What all tasks know: ids from `least` on, `parts` indices per document, `size` in all, `shards` ranges."""

    least: int
    parts: int
    size: int
    shards: int


def layout_of(docs: DataFrame, length: int, shard_bytes: int) -> Layout:
    """From one pass over ids and text lengths: a byte-level id covers a byte at least, which bounds the sequences."""
    most = F.ceil((F.coalesce(F.octet_length("text"), F.lit(0)) + 1) / length)
    row = docs.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max(most).alias("parts"), F.sum(most).alias("n")).first()
    low, high, parts = row.low or 0, row.high or 0, row.parts or 1
    # One more document's worth of indices is for rows without id. Ids too far apart fold: equal places are still ranked.
    return Layout(low, parts, min((high - low + 2) * parts, 2**62), 1 + (row.n or 0) * stride(length) // shard_bytes)


def records(docs: DataFrame, vocabulary: Vocabulary, layout: Layout, length: int, key: int) -> DataFrame:
    """(shard, place, record) for every sequence."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    width = -(-layout.size // layout.shards)

    def run(batches):
        encoder, end = sent.value.encoder(), sent.value.end
        for batch in batches:
            index, rows = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*(encoder.encode_ordinary(text) if text else ()), end], dtype="<u2")
                name = (NO_ID if doc is None else doc).to_bytes(8, "big", signed=True)
                base = ((layout.size // layout.parts - 1) if doc is None else doc - layout.least) * layout.parts
                for part, at in enumerate(range(0, len(ids), length)):
                    own = ids[at : at + length]
                    head = name + part.to_bytes(4, "big") + len(own).to_bytes(4, "big")
                    rows.append(head + own.tobytes() + bytes(2 * (length - len(own))))
                    index.append((base + part) % layout.size)
            place = permuted(np.array(index, np.uint64), layout.size, key)
            for at in range(0, len(rows), 4096):
                some = place[at : at + 4096]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((some // width).astype(np.int32)), pa.array(some), pa.array(rows[at : at + 4096], pa.binary())],
                    names=["shard", "place", "record"],
                )

    return docs.mapInArrow(run, "shard int, place bigint, record binary")


def write_shards(
    docs: DataFrame, vocabulary: Vocabulary, path: str, length: int = LENGTH, key: int = 0,
    shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text: str = "text",
) -> None:
    """Writes the sequences of all documents to `path` in training order, a folder per shard.

    Null and empty texts give one sequence with the end mark alone. Rows without id stand under the least long.
    Repeated rows keep a slot each; rows that share id and number are ordered by their content. An
    empty table gives no shards. The same input and key give the same files, so a failed task or run is repeated safely.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"))
    layout = layout_of(rows, length, shard_bytes)
    found = records(rows, vocabulary, layout, length, key)
    sorted_ = found.repartition(layout.shards, "shard").sortWithinPartitions("shard", "place", "record")
    # The text writer copies bytes as they are, and ends each record with a line feed.
    sorted_.select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").text(path)


def manifest(spark: SparkSession, path: str, length: int = LENGTH) -> DataFrame:
    """(shard, path, first_slot, n): the shards in order, from the lengths of their files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "length")
    shard = F.regexp_extract("path", r"/shard=([0-9]+)/", 1).cast("int")
    counts = files.select(shard.alias("shard"), "path", (F.col("length") / stride(length)).cast("bigint").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first_slot", F.coalesce(F.sum("n").over(before), F.lit(0)))


def read_shards(spark: SparkSession, path: str, length: int = LENGTH, start: int = 0, count: int | None = None, raw: bool = False) -> DataFrame:
    """(slot, shard, doc_id, part, ids) of the slots from `start` on, `count` of them or all.

    Only shards that hold such slots are read, from the record of the first one. With `raw`, ids are their two-byte
    values as binary, else an array.
    """
    last = 2**63 - 1 if count is None else start + count
    shards = manifest(spark, path, length).where((F.col("first_slot") < last) & (F.col("first_slot") + F.col("n") > start))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    rows = files.join(F.broadcast(shards), "path").select("shard", "first_slot", "content")
    size = stride(length)

    def run(batches):
        for batch in batches:
            for shard, first, content in zip(*(batch.column(i) for i in range(3)), strict=True):
                table = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, size)
                shard, first = shard.as_py(), first.as_py()
                low, high = max(0, start - first), min(len(table), last - first)
                for at in range(low, high, 2048):
                    some = table[at : min(at + 2048, high)]
                    head = some[:, :HEADER]
                    number = lambda a, b, kind, h=head: np.ascontiguousarray(h[:, a:b]).view(kind).ravel()
                    doc, n = number(0, 8, ">i8").astype(np.int64), number(12, 16, ">i4").astype(np.int32)
                    body = np.ascontiguousarray(some[:, HEADER:-1]).view("<u2")
                    if raw:
                        ids = pa.array([own[:k].tobytes() for own, k in zip(body, n)], pa.binary())
                    else:
                        kept = body[np.arange(length)[None, :] < n[:, None]].astype(np.int32)
                        ids = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(n))).astype(np.int32), kept)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.arange(first + at, first + at + len(some))),
                            pa.array(np.full(len(some), shard, np.int32)),
                            pa.array(doc, mask=doc == NO_ID),
                            pa.array(number(8, 12, ">i4").astype(np.int32)),
                            ids,
                        ],
                        names=["slot", "shard", "doc_id", "part", "ids"],
                    )

    kind = "binary" if raw else "array<int>"
    return rows.mapInArrow(run, f"slot bigint, shard int, doc_id bigint, part int, ids {kind}")
