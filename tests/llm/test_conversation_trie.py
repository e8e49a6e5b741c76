"""The prefix trie equals a plain one, however it is cut into blocks and shards."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tipoff.llm.conversation_trie import DoubleArray, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(ts, key=lambda x: x[0])] for c, ts in own.items()}
    nodes = defaultdict(lambda: {"members": [], "ends": [], "children": set()})
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + ts[h:])
        for d in range(len(path) + 1):
            nodes[path[:d]]["members"].append(c)
            if d:
                nodes[path[:d - 1]]["children"].add(path[:d])
        nodes[path]["ends"].append(c)
    out = []
    for path, x in nodes.items():
        leaves = saved = 0
        below = [path]
        while below:
            p = below.pop()
            leaves += not nodes[p]["children"]
            saved += (len(nodes[p]["members"]) - 1) * (len(p[-1][1]) if p else 0)
            below += nodes[p]["children"]
        ends = ",".join(map(str, sorted(x["ends"])))
        out.append((min(x["members"]), len(path), min(nodes[path[:-1]]["members"]) if path else -1, len(x["members"]), len(x["children"]),
                    leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
                  for r in df.collect())


def conversations(seed, count=60, texts=3, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(420), count):
        for turn in range(rng.randrange(1, longest)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["", "é", "ab", None, "longer one"][:texts + 2])))
    # a long one with a copy, and one that ends in the middle of it
    talk = [(turn, "user", f"t{turn % 4}") for turn in range(23)]
    rows += [(c, *t) for c in (700, 801, 802) for t in talk[:11 if c == 802 else None]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("segment,shard_turns", [(64, 200_000), (64, 6), (4, 6), (2, 3), (3, 1)])
def test_equals_a_plain_trie(spark, segment, shard_turns):
    rows = conversations(segment)
    assert rows_of(prefix_trie(spark.createDataFrame(rows, SCHEMA), segment, shard_turns)) == plain(rows)


def test_nulls_and_extra_columns(spark):
    rows = [(1, None, None, "b"), (1, 0, "user", None), (None, 0, "user", "x"), (100, 1, "user", "c"), (100, None, "a", ""), (-205, 3, "user", "d"), (101, 0, "a", "")]
    df = spark.createDataFrame([(*r, 5, "z") for r in rows], SCHEMA + ", n long, parent string")
    assert rows_of(prefix_trie(df)) == plain(rows)


def test_equal_turn_numbers_do_not_depend_on_the_order_of_rows(spark):
    rows = [(7, 1, "user", x) for x in "abc"] + [(7, 1, "user", "a"), (8, 1, "user", "b")] + [(8, 1, "user", x) for x in "caa"]
    one, other = (rows_of(prefix_trie(spark.createDataFrame(r, SCHEMA))) for r in (rows, rows[::-1]))
    assert one == other


def test_only_conversations_without_turns(spark):
    ids = [c for c in range(1, 60) if zlib.crc32(str(c).encode()) % 6 >= 1][:3]
    rows = [(c, 0, "user", "x") for c in ids]
    assert rows_of(prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    assert plain(rows)[0][3:6] == (3, 0, 1)


def test_empty_table(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_double_array_finds_every_path_and_no_other():
    rng = np.random.default_rng(3)
    paths = sorted({tuple(rng.integers(1, 40, rng.integers(0, 7))) for _ in range(500)})
    lengths = np.array([len(p) for p in paths])
    trie = DoubleArray(np.array([c for p in paths for c in p], np.int64), np.append(0, np.cumsum(lengths))[:-1], lengths)
    prefixes = {p[:d] for p in paths for d in range(len(p) + 1)}
    seen = {(): 0}
    for p in sorted(prefixes, key=len):
        if p:
            parent = seen[p[:-1]]
            seen[p] = int(trie.base[parent] + p[-1])
            assert trie.check[seen[p]] == parent
    assert len(set(seen.values())) == len(prefixes) == sum(map(len, trie.levels))
    for p, slot in seen.items():
        for code in range(1, 40):
            child = int(trie.base[slot] + code)
            held = p + (code,) in prefixes
            assert held == (0 <= child < len(trie.check) and trie.check[child] == slot)
