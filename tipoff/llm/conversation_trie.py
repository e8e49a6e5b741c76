"""Prefix trie of conversations, in double arrays per prefix shard.

Conversations are rebuilt and cut into segments of ``SEGMENT`` turns. Equal segments behind equal beginnings are one path with the number of its
conversations, so copies cost nothing further. The paths behind one beginning form a block; a block is cut into shards by the first 1, 2, 4, ...
turns of its paths, until a shard has at most ``SHARD_TURNS`` turns. So neither a hot first turn nor a very long conversation meets in one task.

A shard's task numbers its distinct turns densely and packs its trie into BASE and CHECK arrays: the child of slot s by turn c is slot BASE[s] + c, if
CHECK there says s. Walking all paths through the arrays at once gives the nodes with their members; sums over subtrees go up level by level.
Nodes above a shard's cut are shared with other shards: their partial aggregates are merged by key, and what each adds to its ancestors in the
block (at most ``SEGMENT``) is summed. The totals of blocks below go up by pointer jumping over the blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tipoff.llm.frames import broadcast_if_small, in_batches
from tipoff.operators.ordered import ORDINAL, TOTAL, numbered
from tipoff.session import written

#: Turns of a path in one block, and turns of distinct paths in one shard (unless it is one path).
SEGMENT, SHARD_TURNS = 64, 200_000
#: A conversation begins with turns of the first one of its hundred: fewer than this number, by the checksum of its id.
HUNDRED, LEADS = 100, 6

NO_MEMBERS = hashlib.sha256(b"").hexdigest()
_BLOCK = ["s", "r1", "r2"]
_PATH = [*_BLOCK, "q1", "q2"]
_KEY = ["a", "b"]


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of every rebuilt conversation, and (conv_id, length, pos, k1, k2, chars) of its turns.

    k1 and k2 stand for role and text. Turns are in the order of ``turn`` (null first), equal ones in that of k1 and k2, so that it does not depend
    on files. Rows without conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("k1"), F.xxhash64(F.lit(1), text, role).alias("k2"),
        F.char_length(text).cast("long").alias("chars"))
    lead = F.crc32(F.col("conv_id").cast("string").cast("binary")) % LEADS
    placed = written(numbered(turns, ("turn", "k1", "k2"), by=("conv_id",)).select(
        "conv_id", ORDINAL, TOTAL, lead.alias("h"), "k1", "k2", "chars"), "turns")
    element = F.struct(F.col(ORDINAL).alias("pos"), "k1", "k2", "chars")
    heads = placed.where((F.col("conv_id") % HUNDRED == 0) & (F.col(ORDINAL) < LEADS)).groupBy(F.col("conv_id").alias("origin")).agg(
        F.sort_array(F.collect_list(element)).alias("head"))  # fewer than LEADS
    none = F.array().cast("array<struct<pos:bigint,k1:bigint,k2:bigint,chars:bigint>>")
    found = placed.where(F.col(ORDINAL) == 0).withColumn("origin", F.col("conv_id") - F.col("conv_id") % HUNDRED)
    found = found.select("conv_id", TOTAL, "h", "origin").join(heads, "origin", "left")
    found = found.withColumn("lead", F.slice(F.coalesce("head", none), F.lit(1), F.col("h").cast("int")))
    length = F.size("lead") + F.greatest(F.lit(0), F.col(TOTAL) - F.col("h"))
    found = written(found.select("conv_id", F.col("h").alias("from"), "lead", length.alias("length")), "conversations")
    first = found.select("conv_id", "length", F.explode("lead").alias("t")).select("conv_id", "length", "t.pos", "t.k1", "t.k2", "t.chars")
    own = placed.where(F.col(ORDINAL) >= F.col("h")).join(found.select("conv_id", "length", F.size("lead").alias("after")), "conv_id")
    own = own.select("conv_id", "length", (F.col(ORDINAL) - F.col("h") + F.col("after")).alias("pos"), "k1", "k2", "chars")
    return found.select("conv_id", "length"), first.unionByName(own)


def _segments(found: DataFrame, turns: DataFrame, segment: int) -> DataFrame:
    """(conv_id, last, s, r1, r2, q1, q2, c1, c2, turns): the segments of every conversation.

    r is the key of the block in which a segment lies (what comes before it), q that of its turns, c that of the block behind it, null at the end.
    Only conversations of several segments are windowed, with a row for each segment.
    """
    kind = "array<struct<k1:bigint,k2:bigint,chars:bigint>>"
    element = F.struct("pos", "k1", "k2", "chars")
    cut = turns.groupBy("conv_id", "length", F.expr(f"pos div {segment}").alias("s")).agg(F.sort_array(F.collect_list(element)).alias("t"))  # at most `segment`
    cut = cut.select("conv_id", "length", "s", F.transform("t", lambda x: F.struct(x["k1"].alias("k1"), x["k2"].alias("k2"), x["chars"].alias("chars"))).alias("turns"))
    empty = found.where("length = 0").select("conv_id", "length", F.lit(0).cast("long").alias("s"), F.array().cast(kind).alias("turns"))
    cut = cut.unionByName(empty).select("*", F.xxhash64("turns").alias("q1"), F.xxhash64(F.lit(1), "turns").alias("q2"))
    short, long = cut.where(F.col("length") <= segment), cut.where(F.col("length") > segment)
    before = Window.partitionBy("conv_id").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    key = lambda n: F.xxhash64(F.lit(n), "s", "q1", "q2")
    block = lambda n: F.coalesce(F.bit_xor(key(n)).over(before), F.lit(0).cast("long"))
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    last = (F.col("s") + 1) * segment >= F.col("length")
    short = short.select("conv_id", F.lit(True).alias("last"), "s", zero.alias("r1"), zero.alias("r2"), "q1", "q2", none.alias("c1"), none.alias("c2"), "turns")
    long = long.select("conv_id", last.alias("last"), "s", block(2).alias("r1"), block(3).alias("r2"), "q1", "q2", "turns")
    behind = lambda n, r: F.when(~F.col("last"), key(n).bitwiseXOR(F.col(r)))
    long = long.select("conv_id", "last", *_PATH, behind(2, "r1").alias("c1"), behind(3, "r2").alias("c2"), "turns")
    return written(short.unionByName(long), "segments")


def _ends(segments: DataFrame) -> DataFrame:
    """(path, ends): SHA-256 of the ids of the conversations that end with a path, in ascending order.

    One digest is sequential by nature: its ids, and nothing else, pass one task in order, a batch at a time.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(digests(batches), pa.schema([*[(c, pa.int64()) for c in _PATH], ("ends", pa.string())]))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, sha = None, None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(len(_PATH))])
            ids = batch.column(len(_PATH)).to_pylist()
            changes = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1 if len(ids) else []
            for start, end in zip([0, *changes], [*changes, len(ids)]):
                if start == end:
                    continue
                here = tuple(keys[:, start].tolist())
                if here != at:
                    if at is not None:
                        yield *at, sha.hexdigest()
                    at, sha = here, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(",".join(map(str, ids[start:end])).encode())
        if at is not None:
            yield *at, sha.hexdigest()

    rows = segments.where("last").select(*_PATH, "conv_id").repartition(*_PATH).sortWithinPartitions(*_PATH, "conv_id")
    return rows.mapInArrow(digest, ", ".join(f"{c} long" for c in _PATH) + ", ends string")


def _sharded(paths: DataFrame, segment: int, shard_turns: int) -> DataFrame:
    """The paths with ``t``, the turns above their shard's cut, and ``cut``, the shard's key."""
    done, open_, t = None, paths, 1
    while True:
        cut = open_.select("*", F.lit(t).alias("t"), F.xxhash64(F.slice("turns", 1, t)).alias("cut"))
        if t < segment:  # the paths of a block differ, so a shard cut behind all turns has one
            sizes = cut.groupBy(*_BLOCK, "cut").agg(F.sum(F.size("turns") + 1).alias("held"))
            heavy = written(sizes.where(F.col("held") > shard_turns).select(*_BLOCK, "cut"), "heavy")
            n = heavy.count()
        else:
            n = 0
        if not n:
            return cut if done is None else done.unionByName(cut)
        heavy = broadcast_if_small(heavy, 40, n)
        light = cut.join(heavy, [*_BLOCK, "cut"], "left_anti")
        done = light if done is None else done.unionByName(light)
        open_ = written(cut.join(heavy, [*_BLOCK, "cut"], "left_semi").drop("t", "cut"), "open")
        t *= 2


class DoubleArray:
    """A trie in BASE and CHECK arrays, built level by level from paths of dense turn ids (1 and up). Slot 0 is the root."""

    TRIES = 32  # free places tried for a node of several children before it goes to the end

    def __init__(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.base, self.check = np.zeros(1, np.int64), np.full(1, -1, np.int64)
        self.taken = np.ones(1, bool)
        self.levels: list[np.ndarray] = [np.zeros(1, np.int64)]
        self.parts = (codes, starts, lengths)
        width = int(codes.max()) + 1 if len(codes) else 1
        here = np.zeros(len(starts), np.int64)
        for d in range(int(lengths.max()) if len(lengths) else 0):
            going = np.flatnonzero(lengths > d)
            pairs, back = np.unique(here[going] * width + codes[starts[going] + d], return_inverse=True)
            slots = self._place(pairs // width, pairs % width)
            here[going] = slots[back]
            self.levels.append(slots)

    def _grow(self, size: int) -> None:
        more = size - len(self.base)
        if more > 0:
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, -1, np.int64))
            self.taken = np.append(self.taken, np.zeros(more, bool))

    def _place(self, parents: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Slots of the children (parent, code), which are sorted by parent and code."""
        slots = np.zeros(len(parents), np.int64)
        first = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
        count = np.diff(np.append(first, len(parents)))
        for at, k in zip(first[count > 1].tolist(), count[count > 1].tolist()):
            own = codes[at:at + k]
            base = self._fit(own)
            self._grow(base + int(own[-1]) + 1)
            slots[at:at + k] = base + own
            self.taken[base + own] = True
            self.base[parents[at]] = base
        single = first[count == 1]  # an only child fits into any free slot
        free = np.flatnonzero(~self.taken)[:len(single)]
        free = np.append(free, np.arange(len(self.base), len(self.base) + len(single) - len(free)))
        self._grow(int(free[-1]) + 1 if len(free) else 0)
        slots[single] = free
        self.taken[free] = True
        self.base[parents[single]] = free - codes[single]
        self.check[slots] = parents
        return slots

    def _fit(self, codes: np.ndarray) -> int:
        """The first base, among a few, at which the slots of all codes are free; else one behind the arrays."""
        for slot in np.flatnonzero(~self.taken)[:self.TRIES].tolist():
            wanted = codes + (slot - int(codes[0]))
            inside = wanted[wanted < len(self.taken)]
            if not self.taken[inside].any():
                return slot - int(codes[0])
        return len(self.base) - int(codes[0])

    def walk(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each depth from 0: the paths that reach it and the slots where they are."""
        codes, starts, lengths = self.parts
        going, here = np.arange(len(starts)), np.zeros(len(starts), np.int64)
        d = 0
        while len(going):
            yield going, here
            on = lengths[going] > d
            going, here = going[on], here[on]
            child = self.base[here] + codes[starts[going] + d]
            assert (self.check[child] == here).all()
            here, d = child, d + 1


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(parent: np.ndarray, turn: np.ndarray, factor: np.uint64) -> np.ndarray:
    x = (parent ^ (parent >> np.uint64(31))) * factor + turn
    x = (x ^ (x >> np.uint64(29))) * _M1
    return x ^ (x >> np.uint64(32))


_NODE = [("s", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("pa", pa.int64()), ("pb", pa.int64()), ("level", pa.int64()), ("n", pa.int64()),
         ("least", pa.int64()), ("parent_least", pa.int64()), ("chars", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()),
         ("saved", pa.int64()), ("inner", pa.bool_()), ("goes_on", pa.bool_()), ("upper", pa.bool_()), ("ends", pa.string()), ("above", pa.list_(pa.int64()))]
_NODE_SQL = ("s long, a long, b long, pa long, pb long, level long, n long, least long, parent_least long, chars long, children long, leaves long, "
             "saved long, inner boolean, goes_on boolean, upper boolean, ends string, above array<long>")


def _shard_nodes(block: tuple[int, int, int], t: int, rows: pa.Table) -> pa.RecordBatch:
    """The nodes of one shard. ``above`` (keys from the block's root to the node) is only kept where something is added to ancestors later."""
    turns = rows.column("turns").combine_chunks()
    lengths = np.diff(turns.offsets.to_numpy()).astype(np.int64)
    starts = np.append(0, np.cumsum(lengths))[:-1]
    flat = turns.flatten()
    keys = np.stack([flat.field(k).to_numpy(zero_copy_only=False) for k in range(2)]) if len(flat) else np.zeros((2, 0), np.int64)
    distinct, first, codes = np.unique(keys, axis=1, return_index=True, return_inverse=True)
    chars_of = flat.field(2).to_numpy(zero_copy_only=False)[first] if len(flat) else np.zeros(0, np.int64)
    codes = codes.reshape(-1).astype(np.int64) + 1  # dense, from 1
    trie = DoubleArray(codes, starts, lengths)
    size = len(trie.base)
    n, least = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
    chars, level = np.zeros(size, np.int64), np.zeros(size, np.int64)
    a, b = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
    a[0], b[0] = (np.array(block[1:], np.int64).view(np.uint64))
    path_n, path_least = rows.column("n").to_numpy(), rows.column("least").to_numpy()
    end_at = np.zeros(len(starts), np.int64)
    for d, (going, here) in enumerate(trie.walk()):
        np.add.at(n, here, path_n[going])
        np.minimum.at(least, here, path_least[going])
        end_at[going] = here
        if d:
            slots = trie.levels[d]
            parents = trie.check[slots]
            turn = slots - trie.base[parents] - 1
            level[slots], chars[slots] = d, chars_of[turn]
            a[slots] = _mixed(a[parents], distinct[0][turn].view(np.uint64), _M1)
            b[slots] = _mixed(b[parents], distinct[1][turn].view(np.uint64), _M2)
    inner, goes_on = np.zeros(size, bool), np.zeros(size, bool)
    ends: dict[int, str] = {}
    for path, (digest, c1, c2) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("ends", "c1", "c2")))):
        slot = int(end_at[path])
        if digest is not None:
            ends[slot] = digest
        if c1 is not None:  # the node is the root of the block behind it, and has that block's key
            goes_on[slot] = True
            a[slot], b[slot] = np.array([c1, c2], np.int64).view(np.uint64)
    used = np.concatenate(trie.levels)
    parents = trie.check[used[1:]]
    inner[parents] = True
    whole = level >= t  # all members of these nodes are in this shard
    leaves = (whole & ~inner & ~goes_on).astype(np.int64)
    saved = np.where(whole, (n - 1) * chars, 0)
    children = np.zeros(size, np.int64)
    np.add.at(children, parents, whole[used[1:]].astype(np.int64))
    for slots in reversed(trie.levels[1:]):
        np.add.at(leaves, trie.check[slots], leaves[slots])
        np.add.at(saved, trie.check[slots], saved[slots])
    parent = np.maximum(trie.check[used], 0)
    a, b = a.view(np.int64), b.view(np.int64)

    def keys_above(slot: int) -> list[int]:
        up: list[int] = []
        while slot >= 0:
            up += [int(b[slot]), int(a[slot])]
            slot = int(trie.check[slot])
        return up[::-1]

    above = [keys_above(x) if up or on else None for x, up, on in zip(used.tolist(), ~whole[used], goes_on[used])]
    known = (used > 0) & whole[parent]
    columns = [np.full(len(used), block[0]), a[used], b[used], a[parent], b[parent], level[used], n[used], least[used],
               pa.array(least[parent], pa.int64(), mask=~known), chars[used], children[used], leaves[used], saved[used], inner[used], goes_on[used],
               ~whole[used], [ends.get(x) for x in used.tolist()], above]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kind) for c, (_, kind) in zip(columns, _NODE)], schema=pa.schema(_NODE))


def _nodes(shards: DataFrame) -> DataFrame:
    """All shards' nodes; a task takes its shards one after another."""
    fixed = ["s", "r1", "r2", "cut", "t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in fixed])
            if not batch.num_rows:
                continue
            changes = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for start, end in zip([0, *changes], [*changes, batch.num_rows]):
                here = tuple(keys[:, start].tolist())
                if here != at and held:
                    yield _shard_nodes(at[:3], at[4], pa.Table.from_batches(held))
                    held = []
                at = here
                held.append(batch.slice(start, end - start))
        if held:
            yield _shard_nodes(at[:3], at[4], pa.Table.from_batches(held))

    dealt = shards.select(*_BLOCK, "cut", F.col("t").cast("long").alias("t"), "turns", "n", "least", "c1", "c2", "ends")
    dealt = dealt.repartition(*_BLOCK, "cut").sortWithinPartitions(*_BLOCK, "cut", "t")
    return written(dealt.mapInArrow(run, _NODE_SQL), "nodes")


def _added(rows: DataFrame, **values: str) -> DataFrame:
    """(s, a, b, and the sums of ``values``) over the nodes that name a key in ``above``, from the block's root to the row's own node.

    The level s of the block tells a block's root from the node of the block before with the same key.
    """
    pairs = F.expr("transform(sequence(0, size(above) div 2 - 1), i -> struct(above[2 * i] as a, above[2 * i + 1] as b, "
                   "size(above) div 2 - 1 - i as steps))")
    each = rows.select("s", *[F.expr(e).alias(f"v_{c}") for c, e in values.items()], F.explode(pairs).alias("x"))
    each = each.select("s", "x.a", "x.b", "x.steps", *[f"v_{c}" for c in values])
    return each.groupBy("s", "a", "b").agg(*[F.sum(F.col(f"v_{c}")).alias(f"more_{c}") for c in values],
                                      F.sum((F.col("steps") == 1).cast("long")).alias("more_children"))


def _merged(nodes: DataFrame) -> DataFrame:
    """The nodes above the cuts, once each, with all that their shards and the other such nodes below them add."""
    firsts = ["pa", "pb", "level", "chars"]
    upper = nodes.where("upper").groupBy("s", "a", "b").agg(
        *[F.max(c).alias(c) for c in firsts], F.max("above").alias("above"), F.sum("n").alias("n"), F.min("least").alias("least"),
        *[F.sum(c).alias(c) for c in ("children", "leaves", "saved")], F.max("inner").alias("inner"), F.max("goes_on").alias("goes_on"), F.max("ends").alias("ends"))
    upper = written(upper, "upper")
    real = upper.where("level > 0 or s = 0")
    more = _added(real, leaves="cast(not inner and not goes_on as bigint)", saved="(n - 1) * chars")
    joined = upper.join(more, ["s", "a", "b"], "left")
    sums = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("children", "leaves", "saved")]
    return written(joined.select("s", "a", "b", *firsts, "n", "least", *sums, "goes_on", "ends", "above"), "merged")


def _block_totals(roots: DataFrame, joints: DataFrame) -> DataFrame:
    """(a, b, leaves, saved) of each block with all blocks below it, by pointer jumping: as many rounds as the logarithm of the most blocks in a row."""
    parent = joints.select("a", "b", F.col("above")[0].alias("ja"), F.col("above")[1].alias("jb"))
    now = written(roots.where("s > 0").select("a", "b", "leaves", "saved").join(parent, ["a", "b"]), "blocks")
    while now.where("ja is not null").limit(1).count():
        given = now.where("ja is not null").groupBy(F.col("ja").alias("a"), F.col("jb").alias("b")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        jump = now.select(F.col("a").alias("ja"), F.col("b").alias("jb"), F.col("ja").alias("na"), F.col("jb").alias("nb"))
        now = written(now.join(given, ["a", "b"], "left").join(jump, ["ja", "jb"], "left").select(
            "a", "b", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")],
            F.col("na").alias("ja"), F.col("nb").alias("jb")), "blocks")
    return now.select("a", "b", "leaves", "saved")


def prefix_trie(conversations: DataFrame, segment: int = SEGMENT, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has conv_id, turn, role, text; other columns play no part. Null roles and texts are empty, rows without conv_id are left out, repeated
    rows are turns like others, equal turn numbers have an order of their own (see ``rebuilt_turns``). An empty table has no node, not even the root.
    """
    found, turns = rebuilt_turns(conversations.select("conv_id", "turn", "role", "text"))
    segments = _segments(found, turns, segment)
    paths = segments.groupBy(*_PATH).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.max("c1").alias("c1"), F.max("c2").alias("c2"),
                                         F.any_value("turns").alias("turns"))
    paths = written(paths.join(_ends(segments), _PATH, "left"), "paths")
    nodes = _nodes(_sharded(paths, segment, shard_turns))
    upper = _merged(nodes)
    kept = ["s", "a", "b", "pa", "pb", "level", "n", "least", "parent_least", "chars", "children", "leaves", "saved", "goes_on", "ends"]
    lower = nodes.where("not upper").select(*kept, "above")
    rows = lower.unionByName(upper.withColumn("parent_least", F.lit(None).cast("long")).select(*kept, "above"))
    ties = upper.where("level > 0 or s = 0").select("a", "b", "least")
    joints = rows.where("goes_on")
    if joints.limit(1).count():
        roots = upper.where("level = 0")
        joints = written(joints.select("s", "a", "b", "above", "least"), "joints")
        totals = _block_totals(roots, joints)
        more = _added(joints.join(totals, ["a", "b"]), leaves="leaves", saved="saved").drop("more_children")
        below = roots.where("s > 0").select("a", "b", F.col("children").alias("children_behind"))
        rows = rows.join(more, ["s", "a", "b"], "left").join(below, ["a", "b"], "left").select(
            *[c for c in kept if c not in ("leaves", "saved", "children")],
            *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")],
            (F.col("children") + F.when(F.col("goes_on"), F.coalesce("children_behind", F.lit(0))).otherwise(0)).alias("children"))
        ties = ties.unionByName(joints.select("a", "b", "least")).distinct()
    parents = written(ties.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("least").alias("found_least")), "parents")
    rows = rows.where("level > 0 or s = 0").join(broadcast_if_small(parents, 32), ["pa", "pb"], "left")
    root = (F.col("s") == 0) & (F.col("level") == 0)
    return rows.select(
        F.col("least").alias("conv_id"), (F.col("s") * segment + F.col("level")).alias("depth"),
        F.when(~root, F.coalesce("parent_least", "found_least")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_MEMBERS)).alias("ends_sha256"))
