import random

import numpy as np

from tipoff.llm.toxicity import CATEGORIES, _fit, fit_chain, score, without_toxic


def corpus(n, seed=3):
    rng = random.Random(seed)
    plain = [f"word{k}" for k in range(300)] + ["Über", "größe"]
    rows = []
    for k in range(n):
        words = rng.choices(plain, k=rng.choice([5, 40, 300]))
        toxic, poor = rng.random() < 0.15, rng.random() < 0.2
        if toxic:
            words += rng.choices(["scum", "Idiot,", "veju" + rng.choice("abc") + "que"], k=rng.choice([1, 2, 5]))
        if poor:
            words += ["###", "junk"] * 3
        rng.shuffle(words)
        rows.append((k, " ".join(words), int(not poor), int(toxic)))
    return rows


def test_held_out_accuracy_and_clean_documents_stay(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows if r[0] % 3], "doc_id long, quality int, toxic int")
    chain = fit_chain(docs, labels, CATEGORIES)
    found = {r.doc_id: r for r in score(docs, chain).collect()}
    held_out = [r for r in rows if r[0] % 3 == 0]
    assert np.mean([found[r[0]].is_toxic == bool(r[3]) for r in held_out]) > 0.99
    assert not any(found[r[0]].is_toxic for r in held_out if not r[3])
    assert np.mean([found[r[0]].is_low_quality == (not r[2]) for r in held_out]) > 0.99
    kept = without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r.is_toxic for r in found.values())


def test_later_models_use_the_earlier_category(spark):
    rng = random.Random(1)
    rows = [(k, ("mark " if rng.random() < 0.5 else "") + f"w{rng.randrange(50)}") for k in range(1200)]
    labels = [(k, 0 if "mark" in t else 1, int("mark" in t)) for k, t in rows]
    chain = fit_chain(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), CATEGORIES)
    assert chain.links[0, 1] > 0.1 and chain.links[1, 0] == 0


def test_fit_is_near_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.random((400, 6)) < 0.3
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ np.array([3, -2, 1, 0, 0, 2]) - 1)))).astype(float)
    rows, columns = np.nonzero(x)
    w, _, b = _fit(rows, columns, 400, np.zeros((400, 0)), y, 6)
    r = 1 / (1 + np.exp(-(x @ w + b))) - y
    assert np.abs(x.T @ r + 0.5 * w).max() < 0.5 and abs(r.sum()) < 0.5


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "scum", "c"), (2, "", "b"), (3, "scum " * 50_000, "d")], "doc_id long, text string, rejected string")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 0, 1), (9, 0, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    out = without_toxic(docs, labels)
    assert out.columns == docs.columns and out.count() == 5
    assert without_toxic(docs, labels.where("false")).count() == 5
    assert without_toxic(docs.where("false"), labels).count() == 0
