import random
import re
from math import comb

import numpy as np
import pytest

from tipoff.llm.quality import LEVELS, RULES, _by_rule, binomial_below, judge, measures, proved, tightening
from tipoff.llm.shingles import WordHashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    windows = {}
    for k in range(len(words) - 4):
        windows.setdefault(tuple(words[k:k + 5]), []).append(k)
    hit = {w for starts in windows.values() if len(starts) > 1 for k in starts for w in range(k, k + 5)}
    dup = sum(line in lines[:k] for k, line in enumerate(lines))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit))


def texts(n):
    rng = random.Random(8)
    parts = ["a", "b", "word", "Über", "𝒳y", "#", "x|y", " ", "  ", "\n", "\n\n", "\t", "\x0b", " ", "\x1c", "!"]
    return ["".join(rng.choices(parts, k=rng.randrange(0, 90))) for _ in range(n)]


def test_counts_equal_the_plain_definition():
    hashes = WordHashes()
    for text in texts(500) + ["", "same line\nsame line\n same line\n", "a b c d e " * 3]:
        assert measures(text.encode(), hashes)[:5] == brute(text), repr(text)


def test_binomial_tail():
    for n, p in ((1, 0.3), (20, 0.05), (200, 0.01)):
        for k in (0, 1, 3, n):
            exact = sum(comb(n, j) * p ** j * (1 - p) ** (n - j) for j in range(min(k, n) + 1))
            assert binomial_below(k, n, p) == pytest.approx(min(1, exact))


def test_the_path_takes_the_purest_steps_first():
    good, bad = np.zeros((2, LEVELS + 1), int), np.zeros((2, LEVELS + 1), int)
    good[0, 3], bad[0, 100], bad[0, 220], good[0, 150] = 2000, 300, 5, 4
    bad[1, 9], good[1, 9], bad[1, 4], good[1, 4] = 50, 10, 5, 6
    assert tightening(good, bad) == [(0, 220), (0, 100), (1, 9)]
    first = _by_rule([(0, 220), (0, 100), (1, 9)])
    assert (first[0][256], first[0][220], first[0][219], first[0][100], first[0][99], first[1][8], first[1][9]) == (0, 0, 1, 1, 3, 3, 2)


def test_steps_are_proved_in_order():
    assert proved(np.array([0, 0, 3, 30]), 218, 0.05, 0.0125) == 3
    assert proved(np.array([0, 0]), 86, 0.05, 0.0125) == 2
    assert proved(np.array([0, 0]), 85, 0.05, 0.0125) == 0  # too few labels to prove anything
    assert proved(np.array([]), 500, 0.05, 0.0125) == 0


def test_the_joint_risk_holds_in_nearly_all_draws():
    rng, broken, decided = np.random.default_rng(1), 0, 0
    for _ in range(300):
        good = rng.geometric(0.05, (len(RULES), 900)).clip(0, LEVELS)
        bad = rng.geometric(0.01, (len(RULES), 400)).clip(0, LEVELS)
        count = lambda x: np.stack([np.bincount(r, minlength=LEVELS + 1) for r in x])
        steps = tightening(count(good[:, :300]), count(bad))
        first = np.array(_by_rule(steps))
        reached = np.min([first[r][good[r, 300:]] for r in range(len(RULES))], axis=0)
        holds = proved(np.bincount(reached, minlength=len(steps) + 1)[:len(steps)], 600, 0.05, 0.05)
        cut = {}
        for rule, level in steps[:holds]:
            cut[rule] = min(level, cut.get(rule, LEVELS + 1))
        kept = np.prod([1 - 0.95 ** (level - 1) for level in cut.values()]) if cut else 1.0
        broken += 1 - kept > 0.05
        decided += bool(cut)
    assert decided > 250 and broken <= 0.05 * 300 + 12


@pytest.mark.parametrize("folder,languages", [("sf0.01", {"en"}), ("sf0.1", {"en", "de", "fr", "es"})])
def test_given_labels_prove_cutoffs(spark, folder, languages):
    read = lambda name: spark.read.parquet(f"/root/testdata/{folder}/{name}.parquet")
    rows = judge(read("documents"), read("labels")).where("size(reasons) > 0").select("stratum").distinct().collect()
    assert languages <= {r.stratum for r in rows}


def test_verdicts(spark):
    rng = random.Random(2)
    plain = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(2600):
        words = rng.choices(plain, k=60)
        poor = k % 5 == 0
        if poor:
            words = [w + "###" if rng.random() < 0.7 else w for w in words]
        rows.append((k, "en" if k % 13 else None, " ".join(words), "x"))
        labels.append((k, int(not poor), 0))
    rows += [(9001, "en", None, None), (9002, "xx", "too short", None), (9003, "en", "a b c d e " * 20, None), (9003, "en", "a b c d e " * 20, None), (None, "xx", " ".join(plain), None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, kept string")
    out = judge(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    for doc_id, lang, text, _ in rows:
        if doc_id is not None:
            r = by[doc_id]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text)
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert all(by[k].kept for k in range(2600) if k % 5) and by[None].kept
    assert not any(by[k].kept for k in range(2600) if k % 5 == 0 and k % 13)
    # the marks make words longer too, so either rule may name a poor document
    assert set(by[0].reasons) <= {"symbols", "word_length"} and by[5].reasons and set(by[5].reasons) <= {"symbols", "word_length"}
    assert not (by[9001].kept or by[9002].kept or by[9003].kept)
    none = judge(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.kept for r in none.collect() if r.doc_id and r.doc_id < 2600} == {True}
    assert judge(docs.where("false"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
