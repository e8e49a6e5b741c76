"""Files of token ids: documents in ascending doc_id order, as segments of the range coder in a Parquet table.

One row of the table is one segment of whole documents: its place (part, segment), the documents' numbers and lengths, and the coded ids. Parts follow
doc_id, so rows in the order of (part, segment) hold all ids in order. Spark commits the files, so a lost task leaves no half of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tipoff.llm.frames import broadcast_if_small, in_batches, tidied
from tipoff.llm.range_coder import BLOCK, LANES, read_segment, write_segment
from tipoff.llm.tokens import encoder

#: Ids after which a segment ends with the document at hand.
SEGMENT = BLOCK * LANES

SCHEMA = "part long, segment long, n_ids long, doc_ids array<long>, lengths array<long>, coded binary"
_ARROW = pa.schema([("part", pa.int64()), ("segment", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                    ("lengths", pa.list_(pa.int64())), ("coded", pa.binary())])


def write_ids(documents: DataFrame, path: str, vocabulary: str, end_id: int = 1) -> None:
    """Writes the ids of every text of ``documents`` (doc_id, text), each followed by ``end_id``, to ``path``.

    The order is doc_id, rows without one first, and then the text's hash, so that repeated rows have a fixed place too. A null or empty
    text is the end id alone. An empty table gives a table without rows.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digest = F.xxhash64("text")
    in_order = rows.repartitionByRange("doc_id", digest).sortWithinPartitions("doc_id", digest)

    @tidied
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(coded(batches), _ARROW, max_rows=1)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        ids_of, end, part = encoder(vocabulary, False), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []  # documents, their lengths, their ids
        size = segment = 0
        for batch in batches:
            numbers = batch.column(0)
            for lengths, ids in ids_of.encode_column(batch.column(1), end):
                docs, numbers = numbers.slice(0, len(lengths)), numbers.slice(len(lengths))
                while len(lengths):
                    ends = np.cumsum(lengths)
                    n = int(np.searchsorted(ends, SEGMENT - size)) + 1  # the document that fills the segment is its last
                    held.append((docs.slice(0, n), lengths[:n], ids[:ends[:n][-1]]))
                    size += len(held[-1][2])
                    docs, lengths, ids = docs.slice(n), lengths[n:], ids[len(held[-1][2]):]
                    if size >= SEGMENT:
                        yield _segment(part, segment, held)
                        held, size, segment = [], 0, segment + 1
        if held:
            yield _segment(part, segment, held)

    in_order.mapInArrow(segments, SCHEMA).write.parquet(path)


def _segment(part: int, segment: int, held: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> tuple:
    docs, lengths, ids = zip(*held)
    held.clear()
    ids = np.concatenate(ids)
    return part, segment, len(ids), pa.concat_arrays(docs).to_pylist(), np.concatenate(lengths).tolist(), write_segment(ids)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of the files: ``start`` counts the ids of all documents before it."""
    table = spark.read.schema(SCHEMA).parquet(path)
    sizes = table.groupBy("part", "segment").agg(F.sum("n_ids").alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))  # one row for each part file
    before_part = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = sizes.select("part", "segment", (F.sum("n").over(Window.partitionBy("part").orderBy("segment")) - F.col("n")).alias("own"))
    starts = inside.join(before_part, "part").select("part", "segment", (F.col("before") + F.col("own")).alias("first"))

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    @tidied
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(split(batches), schema)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k in range(batch.num_rows):
                first, docs, lengths, data = (batch.column(c)[k].as_py() for c in range(4))
                ids = read_segment(data).tobytes()
                at = 0
                for doc_id, n in zip(docs, lengths):
                    yield doc_id, first + at, n, ids[4 * at:4 * (at + n)]
                    at += n

    placed = table.join(broadcast_if_small(starts, 48), ["part", "segment"])
    return placed.select("first", "doc_ids", "lengths", "coded").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def id_report(documents: DataFrame) -> DataFrame:
    """The documents with a checksum in place of their ids."""
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
