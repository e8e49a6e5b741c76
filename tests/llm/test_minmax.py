"""Min-max near duplicates against all pairs of whole sets."""

import random
import re

import numpy as np
import pytest

from tipoff.llm import minmax
from tipoff.llm.jaccard import Similarity
from tipoff.llm.minmax import near_duplicates

RULE = Similarity(words=4, share=80)


def shingles(text, words=4):
    found = [w for w in re.split("[ \t\n\x0b\x0c\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    size = min(words, len(found))
    return {tuple(found[k:k + size]) for k in range(len(found) - size + 1)} if size else set()


def plain(rows, rule=RULE):
    sets = [(doc_id, shingles(text, rule.words)) for doc_id, text in rows]
    parent = {doc_id: doc_id for doc_id, _ in sets if doc_id is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and i is not None and j is not None and rule.base * len(x & y) >= rule.share * len(x | y):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return sorted((doc_id or -1, len(s), -1 if doc_id is None else root(doc_id), doc_id is None or root(doc_id) == doc_id) for doc_id, s in sets)


def found(df, rule=RULE):
    return sorted((r.doc_id or -1, r.n_shingles, -1 if r.component_id is None else r.component_id, r.kept) for r in near_duplicates(df, rule).collect())


def variants(seed, families=6, each=25, length=90):
    """Families of copies with some words changed: similarities on both sides of the bound, and chains of links."""
    rng = random.Random(seed)
    rows = []
    for f in range(families):
        base = [f"w{rng.randrange(60)}" for _ in range(length)]
        for _ in range(each):
            words = list(base)
            for _ in range(rng.randrange(5)):
                words[rng.randrange(length)] = f"x{rng.randrange(5)}"
            rows.append((rng.randrange(1, 10**6), " ".join(words)))
            base = words if rng.random() < 0.3 else base
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rows = variants(seed)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_many_copies_and_a_large_family_below_the_bound(spark):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base)) for k in range(200, 500)]
    for k in range(500, 640):  # about six changed words each: most pairs of these fail the bound
        words = list(base)
        for at in rng.sample(range(60), 3):
            words[at] = f"y{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_nulls_empty_short_and_repeated_texts(spark):
    long_text = " ".join(f"l{k % 9000}" for k in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE two"), (8, "one two three"), (None, "one two"), (None, None),
            (9, "É é"), (10, "é É"), (11, "É é"), (12, long_text), (13, long_text + " end"), (14, "a b c d e"), (14, "a b c d e"), (15, "a b c d e f")]
    df = spark.createDataFrame([(*r, 5, 6, "x") for r in rows], "doc_id long, text string, n long, node long, band string")
    assert found(df) == plain(rows)


def test_texts_of_one_document_tie(spark):
    rows = [(5, "a b c d e f g h"), (5, "q r s t u v w x"), (9, "a b c d e f g h"), (3, "q r s t u v w x"), (7, "m n o p")]
    assert [r[2] for r in found(spark.createDataFrame(rows, "doc_id long, text string"))] == [3, 3, 3, 7, 3]


def test_empty_table(spark):
    empty = near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_signature_estimates_the_similarity():
    rng = np.random.default_rng(2)
    errors = []
    for similar in (0.5, 0.8, 0.95):
        for _ in range(30):
            universe = np.unique(rng.integers(0, 1 << 63, 400, np.uint64))
            both = int(len(universe) * similar)
            one = (len(universe) - both) // 2
            x, y = (np.sort(np.concatenate([universe[:both], part])) for part in (universe[both:both + one], universe[both + one:]))
            errors.append((minmax.min_max(x) == minmax.min_max(y)).mean() - similar)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def test_no_pair_at_the_bound_is_ruled_out_by_its_signature():
    rng = np.random.default_rng(6)
    for size in (5, 50, 500):
        for _ in range(40):
            universe = rng.integers(0, 1 << 63, size, np.uint64)
            bits = [minmax.bit_planes(minmax.min_max(np.sort(x))).view(np.uint64) for x in (universe[size // 10:], universe[:size - size // 10])]
            differ = np.unpackbits((bits[0] ^ bits[1]).view(np.uint8)).reshape(minmax.PLANES, -1).any(axis=0).sum()
            assert 2 * minmax.PERMUTATIONS - differ >= minmax.least_equal(RULE)


def test_cells_and_rounds_of_centres_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(minmax, "CELL", 3)
    monkeypatch.setattr(minmax, "LARGE", 6)
    monkeypatch.setattr(minmax, "COLUMNS", 7)
    rows = variants(3, families=3)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_long_sets_in_parts():
    hashes = np.arange(1, 30_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    values = minmax.FACTORS[:, None] * hashes[None, :]
    assert (minmax.min_max(hashes) == np.stack([values.min(axis=1), values.max(axis=1)], axis=1)).all()
