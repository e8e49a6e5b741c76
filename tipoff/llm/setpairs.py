"""Sets of word n-grams: one document's, pairs of them held against the bound, and classes that share a document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.frames import broadcast_if_small, in_batches
from tipoff.llm.shingles import WordHashes, distinct_runs
from tipoff.session import written

#: Partners of a set that meet it in one place.
BLOCK_ROWS = 256


def set_of(text: bytes | None, hashes: WordHashes, words: int) -> np.ndarray:
    """Hashes of the distinct n-grams of a text's words (A-Z in lower case, cut at the space and U+0009 to U+000D), ascending."""
    return distinct_runs(hashes.of((text or b"").lower().split()), words)


def reached(x: np.ndarray, y: np.ndarray, rule) -> bool:
    """Whether the overlap of two ascending sets reaches the rule's bound."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or rule.base * len(x) < rule.share * len(y):
        return False
    at = np.searchsorted(y, x)
    return rule.reached(int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)), len(x), len(y))


def confirmed(pairs: DataFrame, sets: DataFrame, rule) -> DataFrame:
    """The distinct pairs (a, b) of nodes whose whole sets reach the bound. ``sets`` has (node, runs).

    The partners of a node are dealt out in blocks of about ``BLOCK_ROWS``; the node's set goes to each of its blocks once. Both come by joins,
    which Spark splits where a node has very many blocks or partners.
    """
    pairs = written(pairs.distinct(), "pairs")
    n = pairs.count()
    blocks = written(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks")), "sizes")
    partners = pairs.join(broadcast_if_small(blocks, 24), "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"), F.lit(1).alias("role"), F.col("b").alias("node"))
    heads = blocks.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), F.col("a").alias("node"))
    asked = partners.unionByName(heads)
    dealt = sets.join(broadcast_if_small(asked, 40, 2 * n), "node").select("a", "block", "role", "node", "runs")

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(linked(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, head = None, None
        for batch in batches:
            for k, (a, block, role, node) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]))):
                runs = np.frombuffer(batch.column(4)[k].as_buffer(), np.uint64)
                if (a, block) != at:
                    at, head = (a, block), None
                if role == 0:
                    head = runs.copy()
                elif head is not None and reached(head, runs, rule):
                    yield a, node

    ordered = dealt.repartition("a", "block").sortWithinPartitions("a", "block", "role")
    return written(ordered.mapInArrow(overlap, "a long, b long").distinct(), "links")


def shared_ids(known: DataFrame) -> DataFrame:
    """Ties (a, b) between the nodes of texts that share a doc_id. ``known`` has (doc_id, node) of all rows."""
    lowest = known.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("hi")).where("a <> hi").select("doc_id", "a")
    return known.join(lowest, "doc_id").select("a", F.col("node").alias("b")).where("a <> b").distinct()
