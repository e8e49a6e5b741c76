"""The pipeline on a small corpus with known cases; each stage against a plain version."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from tipoff.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng = random.Random(12)
    words = [f"word{k}" for k in range(900)]
    rows, toxic = [], {}
    for k in range(500):
        text = rng.choices(words, k=60)
        toxic[k] = int(rng.random() < 0.2)
        if toxic[k]:
            text[5:5] = rng.choices(["scum", "idiot"], k=2)
        rows.append([k, " ".join(text), "en", "src0", 0])
    item = " ".join(rng.choices(words, k=25))
    clean = [k for k in range(500) if not toxic[k]]
    copied, leaked, secret = clean[3], clean[7], clean[11]
    rows[leaked][1] += " " + item
    rows[secret][1] += " token=abcdefgh12345"
    rows += [[600, rows[copied][1], "en", "src1", 0], [601, rows[copied][1] + " tail", "en", "src1", 0], [602, None, None, None, None], [603, "", "en", "x", 0]]
    for r in rows:
        r[4] = None if r[1] is None else len(r[1])
    folder = tmp_path_factory.mktemp("small")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, toxic[k]) for k in range(500)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, toxic, leaked, secret


def test_stages_keep_what_they_should(spark, small):
    folder, rows, toxic, leaked, secret = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = {r[0] for r in rows}
    text = {r[0]: r[1] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        kept = {r.doc_id: r for r in out.collect()}
        want -= {"toxicity": {k for k in toxic if toxic[k]}, "near_duplicates": {600, 601}, "decontamination": {leaked}, "secrets": set()}[name]
        assert kept.keys() == want, name
        docs = spark.createDataFrame(list(kept.values()), docs.schema)
    assert kept[secret].text == re.sub("token=.*", "[secret]", text[secret]) and kept[secret].n_chars == len(kept[secret].text)
    assert all(kept[k].text == text[k] for k in want if k != secret)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == want
    totals = Counter()
    for r in packed:
        totals[r.doc_id] += r.length
    assert all(totals[r.doc_id] == r.doc_tokens for r in packed)


def test_run_equals_the_stages(spark, small):
    out = corpus_pipeline.run(spark, small[0])
    assert out.select("doc_id").distinct().count() > 300 and [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity"


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
