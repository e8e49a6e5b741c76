"""N-gram Jaccard join: pairs of documents whose word n-gram sets overlap enough, and the groups that they form.

The sets are the rows of a sparse document by n-gram incidence matrix. The product of the matrix with its transpose holds
the overlaps; only entries that can reach the bound are made:

* Documents with the same set become one row (the class), so exact copies cost nothing further.
* The columns are ordered from rare to frequent by a sketch of all counts. Two sets of similarity t or more share a column
  within the first n - ceil(t n) + 1 of each, so the product runs over these columns only, and pairs whose sizes
  differ by more than t are dropped at once.
* A first, partial product over a few minimum-hash columns joins each class with one member of its column, and
  verifies these links. It ties together large groups of near copies with a number of links proportional to their size. The second product
  then only makes entries between different groups so found, which is all that can still change a group, and leaves out columns of
  one class alone, whose number bounds what is left to share.
* The entries left are verified with exact overlap counts of the whole sets, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tipoff.llm.components import components
from tipoff.llm.frames import broadcast_if_small, in_batches, raw_texts, schema_of, tidied
from tipoff.llm.shingles import WordHashes, distinct_runs
from tipoff.session import written

#: Cells of the count sketch and cells per row while it is summed.
CELLS, CELL_BLOCK = 1 << 20, 1 << 12
#: Odd multipliers: each gives another order of the hashes, whose smallest one is a minimum hash.
ORDERS = (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Partners of a document that are verified in one place.
BLOCK_ROWS = 256


@dataclass(frozen=True)
class Similarity:
    """Words per n-gram, and the bound as a quotient of whole numbers: intersection * base >= share * union."""

    words: int
    share: int
    base: int = 100

    def prefix(self, n: int, shared: int = 1) -> int:
        """Length of the first columns of a set of ``n`` among which any partner has at least ``shared``, in whatever order."""
        return n + (-self.share * n) // self.base + shared if n else 0

    @staticmethod
    def extra(n: int) -> int:
        """Columns that a set of ``n`` shows partners at least: more for larger sets, which share some by chance."""
        return max(1, n * 4 // 100)

    def least_common(self, n: str) -> F.Column:
        """Columns of the first ones that a set of ``n`` has in common with any partner: what its smallest partner shows."""
        return F.greatest(F.lit(1), F.floor(F.floor(F.expr(f"{n} * {self.share}") / self.base) * 4 / 100))

    def reached(self, common: int, n: int, m: int) -> bool:
        return self.base * common >= self.share * (n + m - common)

    def sizes_fit(self, n: str, m: str) -> F.Column:
        return F.least(n, m) * self.base >= F.greatest(n, m) * self.share


def _words(text: bytes | None) -> list[bytes]:
    """Runs of characters other than the space and U+0009 to U+000D, with A-Z in lower case."""
    return (text or b"").lower().split()


def _sketch(documents: DataFrame, rule: Similarity) -> bytes:
    """For each of ``CELLS`` cells the number of binary digits of its count of n-grams: one byte a cell, whatever the corpus."""
    schema = pa.schema([("block", pa.int32()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, cells = WordHashes(), np.zeros(CELLS, np.int64)
        for batch in batches:
            for text in raw_texts(batch.column(0)):
                # a set may have several columns of one cell: they are counted one by one
                runs = distinct_runs(hashes.of(_words(text)), rule.words)
                np.add.at(cells, (runs & np.uint64(CELLS - 1)).astype(np.int64), 1)
        parts = cells.reshape(-1, CELL_BLOCK)
        yield from in_batches(((k, p.astype("<i4" if p.max() < 1 << 31 else "<i8").tobytes()) for k, p in enumerate(parts) if p.any()), schema)

    def add(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CELL_BLOCK, np.int64)
        for frame in frames:
            for counts in frame["counts"]:
                total += np.frombuffer(counts, "<i4" if len(counts) == 4 * CELL_BLOCK else "<i8")
        yield pd.DataFrame({"block": [key[0]], "levels": [np.ceil(np.log2(total + 1)).astype(np.uint8).tobytes()]})

    parts = documents.select("text").mapInArrow(tidied(count), "block int, counts binary")
    levels = np.zeros((CELLS // CELL_BLOCK, CELL_BLOCK), np.uint8)
    for row in parts.groupBy("block").applyInPandas(add, "block int, levels binary").toLocalIterator():
        levels[row.block] = np.frombuffer(row.levels, np.uint8)
    return levels.tobytes()


FEATURES = schema_of(doc_id=T.LongType(), n=T.LongType(), sig=T.BinaryType(), mins=T.ArrayType(T.LongType()),
                     prefix=T.ArrayType(T.LongType()))


def _features(documents: DataFrame, rule: Similarity, levels: bytes) -> DataFrame:
    """Size, signature, minimum hashes and first columns of every document's set."""
    sent = documents.sparkSession.sparkContext.broadcast(levels)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, level = WordHashes(), np.frombuffer(sent.value, np.uint8)
        orders = [np.uint64(m) for m in ORDERS]
        for batch in batches:
            n, sig, mins, prefix, lengths = [], [], [], [], []
            for text in raw_texts(batch.column(1)):
                runs = distinct_runs(hashes.of(_words(text)), rule.words)
                n.append(len(runs))
                sig.append(xxhash.xxh3_128_digest(runs.tobytes()) if len(runs) else None)
                mins.extend([(runs * m).min() if m != 1 else runs[0] for m in orders] if len(runs) else [0] * len(ORDERS))
                first = rule.prefix(len(runs), rule.extra(len(runs)))
                rank = level[(runs & np.uint64(CELLS - 1)).astype(np.int64)]
                prefix.append(runs[np.argsort(rank, kind="stable")[:first]])
                lengths.append(first)
            long_list = lambda flat, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))
            size = len(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()),
                 long_list(np.array(mins, np.uint64), np.arange(size + 1) * len(ORDERS)),
                 long_list(np.concatenate(prefix) if size else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(lengths)]))],
                names=["doc_id", "n", "sig", "mins", "prefix"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(features), FEATURES)


def _verified(pairs: DataFrame, documents: DataFrame, rule: Similarity) -> DataFrame:
    """The pairs (a, b) of document ids whose whole sets overlap enough.

    The pairs are dealt out in blocks of one row of the product: a document ``a`` and at most about ``BLOCK_ROWS`` of its partners. A set travels once for
    each block that needs it, and a document with any number of partners is spread over many blocks.
    """
    pairs = written(pairs.distinct(), "pairs")
    n_pairs = pairs.count()
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))  # at most a row for each pair
    partners = pairs.join(broadcast_if_small(blocks, 24, n_pairs), "a").select(
        F.col("b").alias("doc_id"), F.struct("a", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"), F.lit(1).alias("role")).alias("use"))
    heads = blocks.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).select(
        F.col("a").alias("doc_id"), F.struct("a", "block", F.lit(0).alias("role")).alias("use"))
    asked = partners.unionByName(heads).groupBy("doc_id").agg(F.collect_list("use").alias("uses"))  # at most two uses for each pair
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(broadcast_if_small(asked, 64, 2 * n_pairs), "doc_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("block", pa.int64()), ("role", pa.int32()), ("doc_id", pa.int64()), ("runs", pa.binary())])
        yield from in_batches(uses(batches), schema)

    def uses(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        hashes = WordHashes()
        for batch in batches:
            for doc_id, text, own in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), batch.column(2).to_pylist()):
                runs = distinct_runs(hashes.of(_words(text)), rule.words).tobytes()
                for use in own:
                    yield use["a"], use["block"], use["role"], doc_id, runs

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(linked(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, heads_now = None, []
        for batch in batches:
            for a, block, role, doc_id, runs in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, block) != at:
                    at, heads_now = (a, block), []
                runs = np.frombuffer(runs, np.uint64)
                if role == 0:
                    heads_now.append(runs)
                elif any(_overlap_reached(head, runs, rule) for head in heads_now):
                    yield a, doc_id

    moved = texts.select("doc_id", "text", "uses").mapInArrow(tidied(sets), "a long, block long, role int, doc_id long, runs binary")
    dealt = moved.repartition("a", "block").sortWithinPartitions("a", "block", "role")
    return written(dealt.mapInArrow(tidied(overlap), "a long, b long").distinct(), "links")


def _overlap_reached(x: np.ndarray, y: np.ndarray, rule: Similarity) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or rule.base * len(x) < rule.share * len(y):
        return False
    at = np.searchsorted(y, x)
    common = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
    return rule.reached(common, len(x), len(y))


def near_duplicates(documents: DataFrame, rule: Similarity) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``documents`` (doc_id, text).

    Two documents link when their n-gram sets reach the rule's bound; ``component_id`` is the smallest doc_id that links
    reach. Null and empty texts have an empty set and link with nothing, not even each other. Rows that share a doc_id are taken as
    one document with several texts: what links to one of them links to all, and each row is returned. A row
    without doc_id keeps a null ``component_id`` and ties nothing.
    """
    levels = _sketch(documents, rule)
    features = written(_features(documents.select("doc_id", "text"), rule, levels), "features")
    known = features.where("doc_id is not null and n > 0")
    classes = written(known.groupBy("sig").agg(F.min(F.struct("doc_id", "n", "mins")).alias("least")).select("sig", "least.*"), "classes")
    grouped = classes.where("false").select(F.col("doc_id").alias("node"), F.col("doc_id").alias("label"))
    links = _verified(_first_pairs(classes, grouped, [0], rule), documents, rule)
    # in one order a class has one centre, so these links are stars and their centres the groups
    grouped = links.select(F.col("b").alias("node"), F.col("a").alias("label"))
    links = links.unionByName(_verified(_first_pairs(classes, grouped, list(range(1, len(ORDERS))), rule), documents, rule))
    grouped = written(components(links), "groups")
    several = written(_several(known), "several")
    more = _verified(_cross_pairs(features, classes, grouped, several, documents, rule, levels), documents, rule)
    ties = _ties(grouped).unionByName(more).unionByName(_shared_ids(known, classes, several))
    labels = components(ties)
    named = classes.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "sig", F.coalesce("label", "doc_id").alias("component_id"))
    alone = features.where("doc_id is null or n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return known.join(named, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def _several(known: DataFrame) -> DataFrame:
    """The doc_ids of texts with different sets."""
    return known.groupBy("doc_id").agg(F.min("sig").alias("x"), F.max("sig").alias("y")).where("x <> y").select("doc_id")


def _shared_ids(known: DataFrame, classes: DataFrame, several: DataFrame) -> DataFrame:
    """Ties between the classes of texts that share a doc_id."""
    ids = known.join(several, "doc_id").select("doc_id", "sig").distinct()
    held = ids.join(classes.select("sig", F.col("doc_id").alias("class_id")), "sig")
    least = held.groupBy("doc_id").agg(F.min("class_id").alias("a"))
    return held.join(least, "doc_id").select("a", F.col("class_id").alias("b")).where("a <> b")


def _ties(grouped: DataFrame) -> DataFrame:
    return grouped.select(F.col("label").alias("a"), F.col("node").alias("b"))


def _first_pairs(classes: DataFrame, grouped: DataFrame, orders: list[int], rule: Similarity) -> DataFrame:
    """Each class with the smallest class that has the same minimum hash, if they are in different groups so far."""
    group = broadcast_if_small(grouped.withColumnRenamed("node", "doc_id"), 32)
    own = classes.join(group, "doc_id", "left").withColumn("g", F.coalesce("label", "doc_id"))
    entries = own.select("doc_id", "n", "g", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.get("mins", F.lit(k)).alias("least")) for k in orders])).alias("e"))
    entries = entries.select("doc_id", "n", "g", "e.k", "e.least")
    centres = entries.groupBy("k", "least").agg(F.min(F.struct("doc_id", "n", "g")).alias("c"), F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi")
    return (entries.join(broadcast_if_small(written(centres.select("k", "least", "c"), "centres"), 56), ["k", "least"]).where("g <> c.g")
            .where(rule.sizes_fit("n", "c.n")).select(F.col("c.doc_id").alias("a"), F.col("doc_id").alias("b")))


def _cross_pairs(features: DataFrame, classes: DataFrame, grouped: DataFrame, several: DataFrame, documents: DataFrame, rule: Similarity, levels: bytes) -> DataFrame:
    """Pairs of classes of different groups that can still reach the bound.

    First, with columns in the order of the sketch, the classes are found that have enough of their first columns in common with other
    groups; no others can have a partner. Among these, the columns that only one class has are counted exactly. They come first in the order of the second
    product and never meet, so it has few entries; its pairs must share a column within the first ones that their two sizes allow,
    and have enough columns that are not theirs alone.
    """
    chosen = features.select("sig", "doc_id", "n", "prefix").join(classes.select("sig", "doc_id"), ["sig", "doc_id"]).dropDuplicates(["sig", "doc_id"])
    group = broadcast_if_small(grouped.withColumnRenamed("node", "doc_id"), 32)
    chosen = written(chosen.join(group, "doc_id", "left").select("doc_id", "n", F.coalesce("label", "doc_id").alias("g"), "prefix"), "chosen")
    near = _between_groups(chosen.select("doc_id", "n", "g", F.explode("prefix").alias("column"))).groupBy("doc_id", "n", "g").agg(F.count("*").alias("common"))
    near = written(near.where(F.col("common") >= rule.least_common("n")).drop("common"), "near")
    asked = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tokens = asked.join(broadcast_if_small(near.select("doc_id").distinct(), 16), "doc_id").mapInArrow(_columns_of(rule), "doc_id long, column long")
    # a column that only the texts of one doc_id have can tie them to no other document
    alone = tokens.groupBy("column").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last")).where("doc_id = last")
    alone = alone.groupBy("doc_id").agg(F.collect_list("column").alias("alone"))
    # with several texts, these columns are of all of them, and say nothing of how many are left of one
    mixed = broadcast_if_small(several.withColumn("mixed", F.lit(True)), 16)
    kept = near.join(alone, "doc_id", "left").join(mixed, "doc_id", "left").select(
        "doc_id", "n", "g", F.coalesce("alone", F.array().cast("array<long>")).alias("alone"), "mixed")
    kept = written(kept.where(F.col("mixed") | ((F.col("n") - F.size("alone")) * rule.base >= F.col("n") * rule.share)).drop("mixed"), "alone")
    rows, columns = kept.agg(F.count("*"), F.coalesce(F.sum(F.size("alone")), F.lit(0))).first()
    placed = asked.join(broadcast_if_small(kept, 64, rows + columns // 8), "doc_id").select("doc_id", "n", "g", "alone", "text")
    sent = documents.sparkSession.sparkContext.broadcast(levels)
    entries = placed.mapInArrow(_first_shared(rule, sent), "doc_id long, n long, g long, shared long, place long, column long")
    live = written(_between_groups(entries), "entries")
    left = live.select("column", *[F.col(c).alias(f"{c}_a") for c in ("doc_id", "n", "g", "shared", "place")])
    right = live.select("column", *[F.col(c).alias(f"{c}_b") for c in ("doc_id", "n", "g", "shared", "place")])
    least = F.ceil(F.expr(f"{rule.share} * (n_a + n_b)") / (rule.base + rule.share))  # overlap that the bound asks for
    return (left.join(right, "column").where("doc_id_a < doc_id_b and g_a <> g_b").where(rule.sizes_fit("n_a", "n_b"))
            .where((F.least("shared_a", "shared_b") >= least) & (F.col("place_a") + least <= F.col("n_a")) & (F.col("place_b") + least <= F.col("n_b")))
            .select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")))


def _between_groups(entries: DataFrame) -> DataFrame:
    """The entries of columns that classes of different groups have."""
    shared = entries.groupBy("column").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("column")
    return entries.join(broadcast_if_small(written(shared, "columns"), 16), "column")


def _columns_of(rule: Similarity):
    """(doc_id, column) for every n-gram of each document's set."""

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                runs = distinct_runs(hashes.of(_words(text)), rule.words).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(runs), doc_id, np.int64)), pa.array(runs)], names=["doc_id", "column"])

    return columns


def _first_shared(rule: Similarity, sent):
    """The first columns of each document that others have too, with their places behind the document's own."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, level = WordHashes(), np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            ids, sizes, groups, alone = (batch.column(k).to_pylist() for k in range(4))
            for doc_id, n, g, own, text in zip(ids, sizes, groups, alone, raw_texts(batch.column(4))):
                runs = distinct_runs(hashes.of(_words(text)), rule.words)
                shared = np.setdiff1d(runs, np.array(own, np.int64).view(np.uint64), assume_unique=True)
                u = len(runs) - len(shared)
                rank = level[(shared & np.uint64(CELLS - 1)).astype(np.int64)]
                picked = shared[np.argsort(rank, kind="stable")[:max(0, rule.prefix(len(runs)) - u)]]
                k = len(picked)
                if k:
                    same = lambda value: pa.array(np.full(k, value, np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [same(doc_id), same(len(runs)), same(g), same(len(shared)), pa.array(np.arange(u, u + k)), pa.array(picked.view(np.int64))],
                        names=["doc_id", "n", "g", "shared", "place", "column"])

    return first


def without_near_duplicates(documents: DataFrame, rule: Similarity = Similarity(5, 80)) -> DataFrame:
    """The rows of the smallest doc_id of each group, one row for each, with the columns of ``documents``.

    Documents without words, and rows without doc_id, stay.
    """
    groups = near_duplicates(documents, rule).select(F.col("doc_id").alias("node"), "component_id").where("node <> component_id")
    extra = written(groups.select("node").distinct(), "extra")
    kept = documents.join(broadcast_if_small(extra, 16), documents["doc_id"] == extra["node"], "left_anti")
    return kept
