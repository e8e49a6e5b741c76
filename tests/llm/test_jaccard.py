import random
import re

import pytest
from pyspark.sql import functions as F

from tipoff.llm import jaccard
from tipoff.llm.components import components
from tipoff.llm.jaccard import Similarity, near_duplicates, without_near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, words, share):
    """Component of every row by comparing all pairs."""
    sets = []
    for _, text in rows:
        found = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        size = min(words, len(found))
        sets.append({tuple(found[k:k + size]) for k in range(len(found) - size + 1)} if found else set())
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= share * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        least[root(k)] = min(doc_id, least.get(root(k), doc_id))
    return sorted((rows[k][0], len(sets[k]), least[root(k)]) for k in range(len(rows)))


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["Über", "É", "a b", "x y"]
    common = " ".join(rng.choices(vocabulary, k=60))
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.45:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
        elif kind < 0.6:
            texts.append(common + " " + " ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 40]))))
        else:
            texts.append(" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 20, 120]))))
    return [(k * 7 % 1009, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("words,share", [(4, 85), (5, 80)])
def test_groups_equal_all_pairs(spark, words, share):
    rows = corpus(words, 260) + [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "W1 w2"), (2004, "w1 W2")]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), Similarity(words, share))
    assert sorted(map(tuple, out.collect())) == brute(rows, words, share)


def test_repeated_ids_null_ids_and_long_texts(spark):
    long = " ".join(f"v{k}" for k in range(60_000))
    rows = [(1, "a b c d e f"), (1, "g h i j k l"), (5, "g h i j k l"), (7, "A b c d e f"), (None, "a b c d e f"), (8, long), (9, long + " end"),
            (8, long)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Similarity(4, 85)).collect()
    assert sorted((r.doc_id, r.component_id) for r in out if r.doc_id) == [(1, 1), (1, 1), (5, 1), (7, 1), (8, 8), (8, 8), (9, 8)]
    assert [r.component_id for r in out if r.doc_id is None] == [None]


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n long, sig string, component_id string")
    assert near_duplicates(empty, Similarity(4, 85)).count() == 0
    rows = [(3, "a b c d e f g", 9, "s", "c"), (2, "a b c d e f g", 8, "t", "d"), (None, None, None, None, None)]
    out = without_near_duplicates(spark.createDataFrame(rows, empty.schema))
    assert out.columns == empty.columns
    assert sorted((r.doc_id or 0, r.n or 0) for r in out.collect()) == [(0, 0), (2, 8)]


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5)]
    out = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert out == {k: 1 for k in range(1, 61)} | {k: 1000 for k in range(1000, 1200)}


def test_second_product_alone_links_texts_that_share_a_doc_id(spark, monkeypatch):
    """Two different texts of one doc_id: the columns of one do not hide the links of the other."""
    first = jaccard._first_pairs
    monkeypatch.setattr(jaccard, "_first_pairs", lambda *a: first(*a).where("false"))
    a, b = ([f"{side}{k}" for k in range(100)] for side in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (4, " ".join(["x", *a[1:]])), (6, " ".join([*b[:-1], "y"])), (8, " ".join(f"c{k}" for k in range(100)))]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Similarity(4, 85))
    assert sorted((r.doc_id, r.component_id) for r in out.collect()) == [(1, 1), (1, 1), (4, 1), (6, 1), (8, 8)]
