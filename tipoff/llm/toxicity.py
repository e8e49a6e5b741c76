"""Toxicity by a classifier chain: each category's linear model also sees the categories before it.

The models are trained on a bounded sample of labelled documents. A document is the set of its words and of the first four and five
bytes of its longer words, so that endings do not hide a stem. In training, a later model is given the earlier categories'
out-of-fold log-odds, from models that did not see the document; in scoring, those of the models fitted on the whole sample.
Every document is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.decontaminate import words
from tipoff.llm.frames import raw_texts
from tipoff.session import written

#: Labelled documents that the models are trained on, features that each model keeps, folds.
SAMPLE_ROWS, FEATURES, FOLDS = 20_000, 512, 5
#: Chi-square (of one degree of freedom) from which a feature is kept; penalty on squared weights.
LEAST_CHI2, PENALTY = 15.0, 0.5


@dataclass
class Chain:
    """Linear models of the categories, in chain order, over the same features."""

    categories: list[str]
    features: np.ndarray  # 32-bit feature hashes, ascending
    weights: np.ndarray  # features x categories
    intercepts: np.ndarray
    links: np.ndarray  # links[j, k]: weight of category j's log-odds in the model of a later category k
    thresholds: np.ndarray


def _of_word(word: bytes) -> set[int]:
    parts = {word} | {b"<" + word[:k] for k in (4, 5) if len(word) >= k}
    return {xxhash.xxh3_64_intdigest(p) & 0xFFFFFFFF for p in parts}


class _Lookup(dict):
    """Positions among the model's features for each word, as bytes; starts anew when it holds ``limit`` words."""

    def __init__(self, features: np.ndarray, limit: int = 400_000):
        super().__init__()
        self.at = {int(f): k for k, f in enumerate(features)}
        self.limit = limit

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = np.array([self.at[f] for f in _of_word(word) if f in self.at], np.uint16).tobytes()
        return value

    def of(self, text: bytes | None) -> np.ndarray:
        return np.unique(np.frombuffer(b"".join(map(self.__getitem__, set(words(text or b"")))), np.uint16))


def _sample(documents: DataFrame, labels: DataFrame, categories: dict[str, str], rows: int) -> DataFrame:
    """(fold, y_<k>, text) of at most ``rows`` labelled documents, chosen by a hash of their number."""
    targets = [F.expr(rule).cast("int").alias(f"y_{k}") for k, rule in enumerate(categories.values())]
    known = labels.where("doc_id is not null").select("doc_id", *targets).dropna()
    known = known.join(documents.where("text is not null").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(rows)
    return (documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
            .select(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS)).cast("int").alias("fold"),
                    *[f"y_{k}" for k in range(len(targets))], "text"))


def _feature_sets(sample: DataFrame) -> DataFrame:
    """The sample with the 32-bit feature hashes of each document in place of its text."""
    names = [c for c in sample.columns if c != "text"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [sorted(set().union(*map(_of_word, set(words(t or b""))))) for t in raw_texts(batch.column(len(names)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(names)], pa.array(held, pa.list_(pa.int64()))], names=[*names, "features"])

    return sample.mapInArrow(sets, ", ".join(f"{c} int" for c in names) + ", features array<long>")


def _fit(rows: np.ndarray, columns: np.ndarray, size: int, dense: np.ndarray, y: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression with a quadratic penalty on sparse 0/1 features and a few dense ones, by scaled accelerated descent."""
    n = len(y)
    if not n or y.min() == y.max():
        share = (y.sum() + 0.5) / (n + 1)
        return np.zeros(width), np.zeros(dense.shape[1]), float(np.log(share / (1 - share)))
    w, c = np.zeros(width), np.zeros(dense.shape[1])
    b = float(np.log(y.mean() / (1 - y.mean())))
    # The curvature is at most a quarter of the squared features; rows of many features make steps smaller by their mean count.
    per_row = np.bincount(rows, minlength=n)
    scale_w = 1 / (0.25 * np.bincount(columns, weights=np.sqrt(per_row[rows] + 1), minlength=width) + PENALTY)
    scale_c = 1 / (0.25 * (dense ** 2 * np.sqrt(per_row + 1)[:, None]).sum(0) + PENALTY)
    scale_b = 1 / (0.25 * np.sqrt(per_row + 1).sum())
    state = (w, c, b)
    for step in range(100):
        pull = step / (step + 3)
        look = [now + pull * (now - old) for now, old in zip((w, c, b), state)]
        state, before = (w, c, b), w
        z = np.bincount(rows, weights=look[0][columns], minlength=n) + dense @ look[1] + look[2]
        r = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        w = look[0] - scale_w * (np.bincount(columns, weights=r[rows], minlength=width) + PENALTY * look[0])
        c = look[1] - scale_c * (dense.T @ r + PENALTY * look[1])
        b = look[2] - scale_b * r.sum()
        if step > 20 and np.abs(w - before).max(initial=0) < 1e-3 and abs(b - state[2]) < 1e-3:
            break
    return w, c, float(b)


def _chosen(counts: np.ndarray, positive: np.ndarray, n: int, n_positive: int, keep: int) -> np.ndarray:
    """Positions of the features that differ most between the classes (chi-square)."""
    if not n or n_positive in (0, n):
        return np.zeros(0, np.int64)
    expected = counts * (n_positive / n)
    score = (positive - expected) ** 2 / np.maximum(expected * (1 - n_positive / n), 1e-9)
    score[counts < 2] = 0
    order = np.argsort(-score, kind="stable")[:keep]
    return np.sort(order[score[order] > LEAST_CHI2])


def fit_chain(documents: DataFrame, labels: DataFrame, categories: dict[str, str], sample_rows: int = SAMPLE_ROWS,
              features: int = FEATURES) -> Chain:
    """A chain over ``categories`` (name: SQL condition on ``labels``), in the order given.

    ``sample_rows`` bounds the labelled rows used; labels without text, doc_id or a value are not used. A category of one class
    only, or an empty table, gives a model that never decides for the category.
    """
    names = list(categories)
    sets = written(_feature_sets(_sample(documents, labels, categories, sample_rows)), "labelled")
    targets = [f"y_{k}" for k in range(len(names))]
    least = 2 if sets.count() < 4000 else 5
    per_fold = [F.sum((F.col("fold") == f).cast("int")).alias(f"n_{f}") for f in range(FOLDS)]
    per_fold += [F.sum(F.when(F.col("fold") == f, F.col(t)).otherwise(0)).alias(f"{t}_{f}") for t in targets for f in range(FOLDS)]
    counted = sets.select("fold", *targets, F.explode("features").alias("feature")).groupBy("feature").agg(*per_fold)
    table = counted.where(" + ".join(f"n_{f}" for f in range(FOLDS)) + f" >= {least}").orderBy("feature").toArrow()
    known = table.column("feature").to_numpy().astype(np.int64)
    counts = np.stack([table.column(f"n_{f}").to_numpy() for f in range(FOLDS)]).astype(float)
    positives = [np.stack([table.column(f"{t}_{f}").to_numpy() for f in range(FOLDS)]).astype(float) for t in targets]

    totals = {r.fold: r for r in sets.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(t).alias(t) for t in targets]).collect()}
    size = np.array([totals[f]["n"] if f in totals else 0 for f in range(FOLDS)])
    size_y = [np.array([totals[f][t] if f in totals else 0 for f in range(FOLDS)]) for t in targets]

    def picks(k: int, out: int | None) -> np.ndarray:
        use = [f for f in range(FOLDS) if f != out]
        return _chosen(counts[use].sum(0), positives[k][use].sum(0), int(size[use].sum()), int(size_y[k][use].sum()), features)

    picked = {(k, out): picks(k, out) for k in range(len(names)) for out in (*range(FOLDS), None)}
    union = np.unique(np.concatenate([*picked.values(), np.zeros(0, np.int64)]))
    fold, y, rows, columns = _collected(sets, targets, known[union])
    at = {int(p): j for j, p in enumerate(union)}
    column_at = [at[int(p)] for p in union]
    assert column_at == list(range(len(union)))

    n, links = len(fold), np.zeros((len(names), len(names)))
    weights, intercepts, thresholds = np.zeros((len(union), len(names))), np.zeros(len(names)), np.ones(len(names)) * 2
    held_out = np.zeros((n, len(names)))
    for k in range(len(names)):
        earlier = held_out[:, :k]
        for out in (*range(FOLDS), None):
            train = fold != out if out is not None else np.ones(n, bool)
            allowed = np.zeros(len(union), bool)
            allowed[[at[int(p)] for p in picked[k, out]]] = True
            use = train[rows] & allowed[columns]
            renumber = np.cumsum(train) - 1
            w, c, b = _fit(renumber[rows[use]], columns[use], len(union), earlier[train], y[train, k], len(union))
            if out is None:
                weights[:, k], links[:k, k], intercepts[k] = w, c, b
            else:
                z = np.bincount(rows, weights=w[columns], minlength=n) + earlier @ c + b if n else np.zeros(0)
                held_out[fold == out, k] = z[fold == out]
        thresholds[k] = _threshold(held_out[:, k], y[:, k])
    used = np.abs(weights).sum(1) > 0
    return Chain(names, known[union][used], weights[used], intercepts, links, thresholds)


def _collected(sets: DataFrame, targets: list[str], keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sample as arrays, of the kept features only: at most sample rows times kept features."""
    sent = sets.sparkSession.sparkContext.broadcast(keep)

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = sent.value
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            found = []
            for a, b in zip(ends, ends[1:]):
                own = np.searchsorted(kept, values[a:b])
                found.append(own[kept[np.minimum(own, len(kept) - 1)] == values[a:b]].astype("<u4").tobytes() if len(kept) else b"")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary())], names=[*batch.schema.names[:-1], "columns"])

    schema = "fold int, " + ", ".join(f"{t} int" for t in targets) + ", columns binary"
    table = sets.mapInArrow(only, schema).toArrow()
    held = [np.frombuffer(v, "<u4").astype(np.int64) for v in table.column("columns").to_pylist()]
    rows = np.repeat(np.arange(len(held)), [len(h) for h in held])
    y = np.stack([table.column(t).to_numpy() for t in targets], 1).astype(float)
    return table.column("fold").to_numpy(), y, rows, np.concatenate([*held, np.zeros(0, np.int64)])


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The log-odds from which the decision has the best F1 on out-of-fold scores, halfway to the next score below."""
    if not len(y) or y.min() == y.max():
        return float("inf")
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][z[order][:-1] == z[order][1:]] = -1  # equal scores fall on one side
    best = int(np.argmax(f1))
    below = z[order][best + 1] if best + 1 < len(y) else z[order][best] - 1
    return float((z[order][best] + below) / 2)


def score(documents: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, p_<category> for each, is_<category> for each) of every row; a null or empty text has no features.

    Repeated rows are scored one by one, rows without doc_id too.
    """
    sent = documents.sparkSession.sparkContext.broadcast(chain)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        lookup = _Lookup(model.features)
        for batch in batches:
            z = np.empty((batch.num_rows, len(model.categories)))
            for row, text in enumerate(raw_texts(batch.column(1))):
                now = model.intercepts + model.weights[lookup.of(text)].sum(0)
                for k in range(1, len(now)):
                    now[k] += now[:k] @ model.links[:k, k]
                z[row] = now
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(v) for v in p.T], *[pa.array(v) for v in (z >= model.thresholds).T]], names=out)

    out = ["doc_id", *[f"p_{c}" for c in chain.categories], *[f"is_{c}" for c in chain.categories]]
    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in chain.categories) + ", " + ", ".join(f"is_{c} boolean" for c in chain.categories)
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(scores, schema)


#: The chain over the given labels: a poor text first, as its probability tells about insults, then a toxic one.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the chain does not take for toxic, with their columns. A text that is rejected goes with all its rows."""
    from tipoff.llm.frames import broadcast_if_small

    chain = fit_chain(documents, labels, CATEGORIES)
    toxic = written(score(documents, chain).where("is_toxic and doc_id is not null").select(F.col("doc_id").alias("rejected")).distinct(), "toxic")
    return documents.join(broadcast_if_small(toxic, 16), documents["doc_id"] == toxic["rejected"], "left_anti")
