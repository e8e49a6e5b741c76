"""Near duplicates by min-max hashing.

A document's set of word n-grams is hashed once; under each of ``PERMUTATIONS`` permutations both the smallest and the largest hash are kept, so half as many
permutations give as many values, and as the two ends of one permutation vary against each other, their share of equal values
estimates the similarity with less variance. Two permutations, four values, are a band. Sets of similarity 0.8 differ in all 32 bands
with a chance of 5e-8 (1 - 0.8^4 to the 32nd power).

Documents with the same set become one row (the class, a node numbered by the set's hash). The classes that share a band form its bucket. No
bucket makes all its pairs. First, one member of each bucket is its centre, the others are compared with it, and links confirmed on whole sets tie
groups together; a bucket that is one group is done. While that still joins groups in large buckets, it is repeated with eight more centres each.
Of the classes left, the n-grams that no other one has are counted: who shares too few with all others has no link to come. What
remains of a bucket is multiplied out in blocks: a task holds the whole sets of about two times ``CELL`` members as a sparse matrix, counts all overlaps between
different groups, and returns only links that join them. So nothing is capped, and no pairs travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tipoff.llm.components import components
from tipoff.llm.frames import broadcast_if_small, in_batches, raw_texts, schema_of
from tipoff.llm.jaccard import Similarity
from tipoff.llm.setpairs import confirmed, set_of, shared_ids
from tipoff.llm.shingles import WordHashes
from tipoff.session import written

#: Permutations, permutations in a band, and permuted hashes held at a time.
PERMUTATIONS, BAND, HELD = 64, 2, 1 << 19
#: Bits of each value that estimate the similarity, and standard deviations below the bound at which a centre does not look at a class (a chance of 1e-9).
PLANES, DEVIATIONS = 4, 6
#: Centres of a bucket in the rounds after the first; entries of a bucket up to which there are no such rounds.
CENTRES, LARGE = 8, 2048
#: Members of a bucket in a cell (two cells meet in a block), n-grams of a cell, and columns of a block that are multiplied at a time.
CELL, CELL_GRAMS, COLUMNS = 256, 1 << 20, 4096

FACTORS = (np.random.default_rng(20_240_601).integers(0, 1 << 63, PERMUTATIONS, np.uint64) << np.uint64(1)) | np.uint64(1)
_FEATURES = schema_of(doc_id=T.LongType(), content=T.LongType(), n=T.LongType(), node=T.LongType(), bands=T.ArrayType(T.LongType()), planes=T.ArrayType(T.LongType()))


def min_max(hashes: np.ndarray) -> np.ndarray:
    """Smallest and largest value of a set's hashes under each permutation: shape (PERMUTATIONS, 2)."""
    out = np.empty((PERMUTATIONS, 2), np.uint64)
    out[:, 0], out[:, 1] = np.uint64(2**64 - 1), 0
    step = HELD // PERMUTATIONS
    for at in range(0, len(hashes), step):
        values = FACTORS[:, None] * hashes[None, at:at + step]
        np.minimum(out[:, 0], values.min(axis=1), out=out[:, 0])
        np.maximum(out[:, 1], values.max(axis=1), out=out[:, 1])
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """One key for each band, from its values and its number."""
    return np.array([xxhash.xxh3_64_intdigest(part.tobytes(), seed=k) for k, part in enumerate(values.reshape(-1, 2 * BAND))], np.uint64).view(np.int64)


def bit_planes(values: np.ndarray) -> np.ndarray:
    """A few bits of every value, plane by plane."""
    flat = values.reshape(-1)
    flat = flat ^ (flat >> np.uint64(32))
    return np.concatenate([np.packbits(((flat >> np.uint64(8 + p)) & np.uint64(1)).astype(np.uint8)).view("<i8") for p in range(PLANES)])


def equal_values(a: str, b: str) -> Column:
    """How many of all values agree in all their planes."""
    words = 2 * PERMUTATIONS // 64
    differ = [" | ".join(f"({a}[{p * words + w}] ^ {b}[{p * words + w}])" for p in range(PLANES)) for w in range(words)]
    return F.lit(2 * PERMUTATIONS) - F.expr(" + ".join(f"bit_count({d})" for d in differ))


def least_equal(rule: Similarity) -> int:
    """Equal values that a pair at the bound has, but for a chance of 1e-9."""
    similar = rule.share / rule.base
    chance, values = similar + (1 - similar) / 2**PLANES, 2 * PERMUTATIONS
    return int(values * chance - DEVIATIONS * (values * chance * (1 - chance)) ** 0.5)


def _node(runs: bytes) -> int:
    return xxhash.xxh3_64_intdigest(runs) - (1 << 63)


def _features(documents: DataFrame, rule: Similarity) -> DataFrame:
    """Size, node, band keys and bit planes of every row's set; ``content`` stands for the text."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, node, bands, planes = [], [], [], []
            for text in raw_texts(batch.column(2)):
                runs = set_of(text, hashes, rule.words)
                n.append(len(runs))
                node.append(_node(runs.tobytes()) if len(runs) else None)
                values = min_max(runs) if len(runs) else None
                bands.append(band_keys(values) if len(runs) else None)
                planes.append(bit_planes(values) if len(runs) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bands, pa.list_(pa.int64())),
                                              pa.array(planes, pa.list_(pa.int64()))], names=_FEATURES.names)

    return documents.select("doc_id", "content", "text").mapInArrow(features, _FEATURES)


def _buckets(classes: DataFrame) -> DataFrame:
    """(band, node) of the bands that several classes have."""
    entries = classes.select(F.explode("bands").alias("band"), "node")
    shared = entries.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("band")
    return written(entries.join(broadcast_if_small(written(shared, "bands"), 16), "band"), "buckets")


def _linkable(live: DataFrame, sets: DataFrame, rule: Similarity) -> DataFrame:
    """The entries whose n-grams are shared with others of these nodes to the extent that any link asks for."""

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, runs in zip(batch.column(0).to_pylist(), batch.column(1)):
                runs = np.frombuffer(runs.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(runs), node, np.int64)), pa.array(runs)], names=["node", "run"])

    nodes = written(live.select("node").distinct(), "nodes")
    held = sets.join(broadcast_if_small(nodes, 16), "node", "left_semi")
    alone = held.mapInArrow(columns, "node long, run long").groupBy("run").agg(F.min("node").alias("node"), F.max("node").alias("last")).where("node = last")
    alone = written(alone.groupBy("node").agg(F.count(F.lit(1)).alias("alone")), "alone")
    left = live.join(broadcast_if_small(alone, 24), "node", "left")
    return left.where(rule.base * (F.col("n") - F.coalesce("alone", F.lit(0))) >= rule.share * F.col("n")).drop("alone")


def _centres(live: DataFrame, each: int, turn: int) -> DataFrame:
    """At most ``each`` members of every bucket: the least node at first, then the least of each cell by a hash."""
    order = F.col("node") if each == 1 else F.xxhash64("node", "band", F.lit(turn))
    cell = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(each))
    chosen = live.select("*", cell.alias("cell")).groupBy("band", "cell").agg(F.min_by(F.struct("node", "g", "n", "planes"), order).alias("c"))
    return written(chosen.select("band", *[F.col(f"c.{x}").alias(f"c_{x}") for x in ("node", "g", "n", "planes")]), "centres")


def _open(entries: DataFrame) -> DataFrame:
    """The entries of buckets that hold several groups."""
    entries = written(entries, "left")
    several = entries.groupBy("band").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("band")
    return written(entries.join(broadcast_if_small(written(several, "several"), 16), "band"), "live")


def _links(buckets: DataFrame, classes: DataFrame, sets: DataFrame, rule: Similarity) -> DataFrame:
    """(a, b): links that tie together all that any links in buckets tie."""
    live = written(buckets.join(classes, "node").withColumn("g", F.col("node")), "live")
    links, each, turn = None, 1, 0
    while True:
        centres = _centres(live, each, turn)
        near = (F.col("g") != F.col("c_g")) & rule.sizes_fit("n", "c_n") & (equal_values("planes", "c_planes") >= least_equal(rule))
        met = live.join(broadcast_if_small(centres, 150), "band").where(near)
        found = confirmed(met.select(F.least("c_node", "node").alias("a"), F.greatest("c_node", "node").alias("b")), sets, rule)
        links = found if links is None else written(links.unionByName(found), "links")
        grouped = written(components(links), "groups")
        done = broadcast_if_small(centres.select("band", F.col("c_node").alias("node")), 24)
        left = live.drop("g").join(done, ["band", "node"], "left_anti").join(broadcast_if_small(grouped, 32), "node", "left")
        live = _open(left.withColumn("g", F.coalesce("label", "node")).drop("label"))
        if turn == 0:
            live = _open(_linkable(live, sets, rule))
        largest = live.groupBy("band").count().agg(F.max("count")).first()[0] or 0
        if largest <= LARGE or not found.limit(1).count():
            return links.unionByName(_multiplied(live, sets, rule))
        each, turn = CENTRES, turn + 1


def block_links(nodes: list[int], groups: list[int], sets: list[np.ndarray], rule: Similarity) -> Iterator[tuple[int, int]]:
    """Links between the sets of a block that join different groups, and no more than join them."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held[column] > 1
    number = np.cumsum(held > 1) - 1
    column, owner = number[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    overlap = np.zeros((len(sets), len(sets)), np.float32)
    cuts = np.searchsorted(column, np.arange(0, (int(column[-1]) if len(column) else 0) + COLUMNS + 1, COLUMNS))
    for k, (start, end) in enumerate(zip(cuts[:-1], cuts[1:])):
        part = np.zeros((len(sets), COLUMNS), np.float32)  # counts below 2^24 are exact
        part[owner[start:end], column[start:end] - k * COLUMNS] = 1
        overlap += part @ part.T
    common = overlap.astype(np.int64)
    linked = rule.base * common >= rule.share * (size[:, None] + size[None, :] - common)
    g = np.array(groups)
    root = {x: x for x in groups}
    for i, j in np.argwhere(np.triu(linked & (g[:, None] != g[None, :]), 1)).tolist():
        x, y = groups[i], groups[j]
        while root[x] != x:
            x = root[x]
        while root[y] != y:
            y = root[y]
        if x != y:
            root[x] = y
            yield nodes[i], nodes[j]


def _multiplied(live: DataFrame, sets: DataFrame, rule: Similarity) -> DataFrame:
    """The links that are left in the buckets. A bucket's members are dealt into cells, and any two cells meet in a block."""
    cells = live.groupBy("band").agg(F.ceil(F.greatest(F.count(F.lit(1)) / CELL, F.sum("n") / CELL_GRAMS)).alias("cells"))
    dealt = live.join(broadcast_if_small(written(cells, "cells"), 24), "band").withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("other")
    uses = dealt.select("band", "node", "g", "cell", other).select(
        "band", F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"), "node", "g")
    uses = written(uses, "uses")
    rows = sets.join(broadcast_if_small(uses, 48), "node").select("band", "i", "j", "node", "g", "runs")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(links(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, nodes, groups, held = None, [], [], []
        for batch in batches:
            for row, (band, i, j, node, g) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:5]))):
                if (band, i, j) != at:
                    if len(held) > 1:
                        yield from block_links(nodes, groups, held, rule)
                    at, nodes, groups, held = (band, i, j), [], [], []
                nodes.append(node)
                groups.append(g)
                held.append(np.frombuffer(batch.column(5)[row].as_py(), np.uint64))
        if len(held) > 1:
            yield from block_links(nodes, groups, held, rule)

    ordered = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return written(ordered.mapInArrow(multiply, "a long, b long").distinct(), "links")


def near_duplicates(documents: DataFrame, rule: Similarity = Similarity(5, 80)) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``documents`` (doc_id, text).

    Two documents link when their n-gram sets reach the rule's bound; ``component_id`` is the smallest doc_id that links reach, and ``kept`` tells
    whether it is the row's own. Null and empty texts have an empty set and link with nothing, not even each other. Rows that share a doc_id
    are one document with several texts: what links to one links to all, and each row is returned. A row without doc_id keeps a
    null ``component_id``, ties nothing and is kept. An empty table has no rows; other columns play no part.
    """
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), "text")
    features = written(_features(documents, rule), "features")
    known = features.where("doc_id is not null and n > 0")
    classes = written(known.groupBy("node").agg(F.min(F.struct("doc_id", "content")).alias("first"), F.count(F.lit(1)).alias("rows"), F.any_value("n").alias("n"),
                                                F.any_value("bands").alias("bands"), F.any_value("planes").alias("planes")), "classes")
    buckets = _buckets(classes)
    links = _links(buckets, classes.select("node", "n", "planes"), _sets(documents, classes, buckets, rule), rule)
    labels = components(links.unionByName(shared_ids(known.select("doc_id", "node"))))
    named = written(classes.select("node", F.col("first.doc_id").alias("doc_id")).join(labels, "node", "left").select(
        "node", "doc_id", F.coalesce("label", "node").alias("label")), "named")
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    rows = known.select("doc_id", "n", "node").join(named.select("node", "label").join(least, "label").select("node", "component_id"), "node").drop("node")
    alone = features.where("doc_id is null or n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return rows.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                                          F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _sets(documents: DataFrame, classes: DataFrame, buckets: DataFrame, rule: Similarity) -> DataFrame:
    """(node, runs): the whole sets of the classes that share a band, once each, from one text of each class."""
    asked = buckets.select("node").distinct().join(classes.select("node", "first", "rows"), "node")
    asked = written(asked.select("node", "rows", F.col("first.doc_id").alias("doc_id"), F.col("first.content").alias("content")), "asked")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                runs = [set_of(t, hashes, rule.words).tobytes() for t in raw_texts(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(runs, pa.binary())], names=["node", "runs"])

    rows = documents.join(broadcast_if_small(asked, 48), ["doc_id", "content"]).select("node", "rows", "text")
    # only rows with the same doc_id and text can meet here twice
    held = rows.where("rows = 1").unionByName(rows.where("rows > 1").dropDuplicates(["node"])).select("node", "text")
    return written(held.mapInArrow(sets, "node long, runs binary"), "sets")
