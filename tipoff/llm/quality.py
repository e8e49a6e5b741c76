"""Quality rules with risk-controlled thresholds.

Each rule is a share between 0 and 1 of a document, in 256 levels; higher is worse. The rules of a stratum are tightened together, along one path
of steps: each step lowers the cutoff of one rule. The path comes from a third of the labelled documents, drawn by the hash of their id: the steps
that reject most bad documents for a good one come first, and those that reject no more bad ones than good ones are left out. The other labelled documents are the
holdout. A document is rejected from the first step on that reaches it by any rule, so the holdout's good documents, counted by that step, tell how
many the rules together reject. From the first step on, the exact binomial test of "more than ``risk`` of the good documents are rejected" is made at
``alpha`` over the number of strata (Bonferroni); the first step that cannot be proved ends the sequence. As the steps are nested and fixed before, the ones before it
hold together: with probability 1 - alpha no stratum loses more than ``risk`` of its good documents. The last of them gives the cutoffs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, inf, lgamma, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.frames import broadcast_if_small, raw_texts
from tipoff.llm.shingles import WordHashes, run_hashes
from tipoff.session import written

#: Greatest share of good documents that the rules together may reject in a stratum, and the chance that this fails anywhere.
RISK, ALPHA = 0.05, 0.05
LEVELS = 256
#: One in so many labelled documents shapes the path; the others are the holdout.
PATH_PART = 3
RULES = ("symbols", "repeated_lines", "repeated_words", "capitals", "exclamations", "word_length")
WINDOW = 5
#: Base rule: too few words, or too large a share (in percent) of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 10, 20

_SPACE = b"\t\n\x0b\x0c\r "
_NOT_COUNTED = _SPACE + bytes(range(0x80, 0xC0))  # white space and the later bytes of a character
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))
_LETTERS = _CAPITALS + bytes(range(97, 123))


def _share(part: int, whole: int) -> int:
    return min(LEVELS, LEVELS * part // whole) if whole > 0 else 0


def measures(text: bytes, hashes: WordHashes) -> tuple[int, int, int, int, int, list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the levels of ``RULES``."""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, _NOT_COUNTED))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip(_SPACE)]
    duplicates = len(lines) - len(set(lines))
    repeated = 0
    if n >= WINDOW:
        runs = run_hashes(hashes.of(words), WINDOW)
        _, back, counts = np.unique(runs, return_inverse=True, return_counts=True)
        again = counts[back] > 1
        if again.any():
            covered = np.zeros(n + 1, np.int64)
            starts = np.nonzero(again)[0]
            covered[starts] += 1
            np.subtract.at(covered, starts + WINDOW, 1)
            repeated = int(np.count_nonzero(np.cumsum(covered)[:n]))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    letters = len(text) - len(text.translate(None, _LETTERS))
    levels = [_share(symbols, n), _share(duplicates, len(lines)), _share(repeated, n), _share(capitals, letters),
              _share(text.count(b"!"), n), _share(chars, 64 * n)]
    return n, chars, symbols, duplicates, repeated, levels


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measured(documents: DataFrame, stratum: str) -> DataFrame:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [measures(t or b"", hashes) for t in raw_texts(batch.column(2))]
            columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(len(_COUNTS))]
            levels = pa.array([f[-1] for f in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, levels], names=["doc_id", "stratum", *_COUNTS, "levels"])

    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), "text")
    schema = "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", levels array<int>"
    out = rows.mapInArrow(measure, schema)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def binomial_below(k: int, n: int, p: float) -> float:
    """Chance of at most ``k`` in ``n`` trials of chance ``p``, term by term in logarithms."""
    if k >= n:
        return 1.0
    terms = [lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * log(p) + (n - j) * log1p(-p) for j in range(k + 1)]
    top = max(terms)
    return min(1.0, exp(top) * sum(exp(t - top) for t in terms))


def tightening(good: np.ndarray, bad: np.ndarray) -> list[tuple[int, int]]:
    """The path: (rule, least level rejected) step by step, from counts of documents by rule and level (0 to ``LEVELS``)."""
    steps = []
    for rule in range(len(good)):
        parts: list[list[int]] = []  # least level, good and bad documents of a run of levels, from the top
        for level in range(LEVELS, 0, -1):
            if not (good[rule, level] or bad[rule, level]):
                continue
            parts.append([level, int(good[rule, level]), int(bad[rule, level])])
            # a run goes before a worse one of the same rule, so runs out of order are one
            while len(parts) > 1 and parts[-1][2] * (parts[-2][1] + parts[-2][2]) >= parts[-2][2] * (parts[-1][1] + parts[-1][2]):
                level_, g, b = parts.pop()
                parts[-1] = [level_, parts[-1][1] + g, parts[-1][2] + b]
        steps += [(-b / (g + b), -b, rule, level) for level, g, b in parts if b > g]
    return [(rule, level) for _, _, rule, level in sorted(steps)]


def proved(rejected: np.ndarray, total: int, risk: float, level: float) -> int:
    """How many steps hold, from the good holdout documents that each step is the first to reject."""
    k = 0
    for step, more in enumerate(rejected):
        k += int(more)
        if not total or binomial_below(k, total, risk) > level:
            return step
    return len(rejected)


def _by_rule(steps: list[tuple[int, int]]) -> list[list[int]]:
    """For each rule and level, the first step that rejects it; the number of steps where none does."""
    first = np.full((len(RULES), LEVELS + 1), len(steps), np.int64)
    for at, (rule, level) in reversed(list(enumerate(steps))):
        first[rule, level:] = at
    return first.tolist()


def fit_cutoffs(measured: DataFrame, labels: DataFrame, good: str = "quality = 1", risk: float = RISK, alpha: float = ALPHA) -> DataFrame:
    """(stratum, cutoffs): the least rejected level of each rule, from all labelled documents that pass the base rule."""
    known = labels.select("doc_id", F.expr(good).alias("good")).where("doc_id is not null and good is not null")
    shapes = F.pmod(F.xxhash64("doc_id"), F.lit(PATH_PART)) == 0
    held = written(measured.where("not base_failed").select("doc_id", "stratum", "levels").join(known, "doc_id").select(
        "stratum", "good", "levels", shapes.alias("shapes")), "labelled")
    strata = max(1, held.select("stratum").distinct().count())
    counts = held.where("shapes").select("stratum", "good", F.posexplode("levels").alias("rule", "level")).groupBy("stratum", "rule", "level").agg(
        F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"))

    def path(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tables = np.zeros((2, len(RULES), LEVELS + 1), np.int64)
        for rule, level, g, b in rows[["rule", "level", "n_good", "n_bad"]].itertuples(index=False):
            tables[:, rule, level] = g, b
        steps = tightening(*tables)
        return pd.DataFrame({"stratum": [key[0]], "rules": [[r for r, _ in steps]], "leasts": [[x for _, x in steps]], "first": [_by_rule(steps)]})

    paths = written(counts.groupBy("stratum").applyInPandas(path, "stratum string, rules array<int>, leasts array<int>, first array<array<int>>"), "paths")
    reached = F.array_min(F.zip_with("first", "levels", lambda steps, level: F.get(steps, level)))
    tested = held.where("good and not shapes").join(broadcast_if_small(paths.select("stratum", "first"), 8 * len(RULES) * LEVELS), "stratum").select(
        "stratum", reached.alias("step")).groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("n"))
    tested = tested.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("step", "n"))).alias("n"))  # an entry for each step at most

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for rules, leasts, n in zip(frame["rules"], frame["leasts"], frame["n"]):
                n = dict(n) if n is not None else {}
                holds = proved(np.array([n.get(k, 0) for k in range(len(rules))]), sum(n.values()), risk, alpha / strata)
                chosen = [LEVELS + 1] * len(RULES)
                for rule, least in zip(rules[:holds], leasts[:holds]):
                    chosen[rule] = min(chosen[rule], least)
                out.append(chosen)
            yield pd.DataFrame({"stratum": frame["stratum"], "cutoffs": out})

    return paths.drop("first").join(tested, "stratum", "left").mapInPandas(choose, "stratum string, cutoffs array<int>")


def judge(documents: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, levels, base_failed, reasons, kept) of every row.

    ``reasons`` names the rules whose cutoff is reached. Null and empty texts have no words and fail the base rule; a null stratum is the
    stratum ''. Repeated rows are judged one by one, and each label counts. A stratum with too few labels to prove any cutoff, or a
    table without labels, rejects by the base rule alone.
    """
    measured = written(_measured(documents, stratum), "measured")
    cutoffs = written(fit_cutoffs(measured, labels, risk=risk, alpha=alpha), "cutoffs")
    joined = measured.join(broadcast_if_small(cutoffs, 200), "stratum", "left")
    over = F.zip_with("levels", "cutoffs", lambda level, least: level >= least)
    names = F.array(*map(F.lit, RULES))
    reasons = F.coalesce(F.filter(F.zip_with(names, over, lambda name, hit: F.when(hit, name)), lambda name: name.isNotNull()),
                         F.array().cast("array<string>"))
    return joined.withColumn("reasons", reasons).select(
        "doc_id", "stratum", *_COUNTS, "levels", "base_failed", "reasons", (~F.col("base_failed") & (F.size("reasons") == 0)).alias("kept"))
