"""Licence scans: which licence a file states, and which it inherits from the directories above it.

Every line of a whole text, every run of words as long as a template (over line ends and comment marks), and the text as a whole, is a sparse
TF-IDF vector over words; its cosine to the vectors of licence templates, one-sentence notices and full licence texts, decides. Inverse document
frequencies of the templates' words are counted over all texts. A file that states nothing takes the licence of the nearest directory above it with a
licence file, found by joins on paths.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.decontaminate import words
from tipoff.llm.frames import broadcast_if_small, in_batches, raw_texts
from tipoff.llm.licence_texts import FULL_TEXTS
from tipoff.session import written

# Wordings of public licence notices, by licence.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal "
        "in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-3.0",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons "
        "Attribution 4.0 International Public License",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons "
        "Attribution-ShareAlike 4.0 International Public License",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons "
        "Attribution-NonCommercial 4.0 International Public License",
    ),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related rights to this work.", "Licensed under CC0 1.0."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}

#: Least cosine of a line, text or run to a notice; of a run to a full text, whose common words alone come near many long
#: texts; and of a run to a notice of under ``SHORT`` words, which inside a line counts only as it stands.
LEAST, LEAST_FULL, LEAST_SHORT, SHORT = 0.75, 0.85, 0.95, 16


@dataclass
class Index:
    """Templates as unit vectors, turned around: for each word the templates that hold it, with their weights."""

    names: list[str]
    postings: dict[bytes, list[tuple[int, float]]]
    idf: dict[bytes, float]
    unknown: float  # for words that no template holds

    def nearest(self, found: list[bytes]) -> tuple[str | None, float]:
        """The licence of the nearest template and the cosine to it; ties fall to the first template."""
        counts = Counter(found)
        dots: dict[int, float] = {}
        square = 0.0
        for word, times in counts.items():
            weight = times * self.idf.get(word, self.unknown)
            square += weight * weight
            for template, own in self.postings.get(word, ()):
                dots[template] = dots.get(template, 0.0) + weight * own
        if not dots:
            return None, 0.0
        best = max(dots, key=lambda t: (round(dots[t], 12), -t))
        return self.names[best], dots[best] / sqrt(square)

    def informative(self, share: float) -> frozenset[bytes]:
        """Words without which no vector reaches the cosine ``share`` to any template, because those left weigh too little in each."""
        by_template: dict[int, list[tuple[float, bytes]]] = {}
        for word, held in self.postings.items():
            for template, own in held:
                by_template.setdefault(template, []).append((own * own, word))
        out: set[bytes] = set()
        for weights in by_template.values():
            left = 1.0
            for square, word in sorted(weights, reverse=True):
                if left < share * share * 0.999:  # the cosine over the words left is at most the root of their squares
                    break
                out.add(word)
                left -= square
        return frozenset(out)


def build_index(counts: dict[bytes, int], documents: int) -> Index:
    """``counts``: in how many documents each word of the templates occurs."""
    names, vectors = [], []
    for name, texts in TEMPLATES.items():
        for text in texts:
            names.append(name)
            vectors.append(Counter(words(text.encode())))
    vocabulary = {w for v in vectors for w in v}
    idf = {w: log((1 + documents) / (1 + counts.get(w, 0))) + 1 for w in vocabulary}
    postings: dict[bytes, list[tuple[int, float]]] = {}
    for k, vector in enumerate(vectors):
        length = sqrt(sum((n * idf[w]) ** 2 for w, n in vector.items()))
        for w, n in vector.items():
            postings.setdefault(w, []).append((k, n * idf[w] / length))
    return Index(names, postings, idf, log(1 + documents) + 1)


@dataclass
class Runs:
    """Notices and full texts as unit vectors over numbered words, for runs of words that slide over a text."""

    names: list[str]
    sizes: list[int]  # words of each template, and of a run that is held against it
    full: list[bool]
    at: dict[bytes, int]
    idf: np.ndarray  # by word number; the last is for words that no template holds
    own: np.ndarray  # template x word number
    least: np.ndarray

    def numbers(self, found: list[bytes]) -> np.ndarray:
        unknown = len(self.at)
        return np.fromiter((self.at.get(w, unknown) for w in found), np.int32, len(found))

    def possible(self, ids: np.ndarray) -> np.ndarray:
        """Templates of which a text holds enough words that some run may reach the least cosine."""
        there = np.unique(ids)
        return np.flatnonzero((self.own[:, there] ** 2).sum(axis=1) >= self.least ** 2 * 0.999)

    def cosine(self, template: int, ids: np.ndarray) -> float:
        numbers, times = np.unique(ids, return_counts=True)
        weights = times * self.idf[numbers]
        return float(weights @ self.own[template, numbers] / sqrt(weights @ weights))

    def nearest(self, template: int, ids: np.ndarray) -> tuple[float, int, int] | None:
        """Cosine, start and end of the nearest run to a template, the first of equals; None where no run reaches the least cosine."""
        size, least = min(self.sizes[template], len(ids)), self.least[template]
        if not size:
            return None
        weights = self.idf[ids]
        sums = lambda values: np.concatenate(([0.0], np.cumsum(values)))
        dots, squares = sums(weights * self.own[template, ids]), sums(weights * weights)
        # repeated words only add to a run's length: the true cosine is at most this
        most = (dots[size:] - dots[:-size]) / np.sqrt(squares[size:] - squares[:-size])
        top = int(most.argmax())
        if most[top] < least - 1e-9:
            return None
        floor = max(least, self.cosine(template, ids[top:top + size])) - 1e-9
        starts = np.flatnonzero(most >= floor)
        exact = (dots[starts + size] - dots[starts]) / np.sqrt(self._squares(ids, starts, size))
        near = exact >= exact.max() - 1e-9
        start = int(starts[near.argmax()])
        cosine = self.cosine(template, ids[start:start + size])
        return (cosine, start, start + size) if cosine >= least - 1e-12 else None

    def _squares(self, ids: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """Squared lengths of the runs at ``starts`` (ascending), each from the one before it."""
        squared, row, out = (self.idf ** 2).tolist(), ids.tolist(), np.empty(len(starts))
        times: Counter[int] = Counter()
        before, total = -size, 0.0
        for k, start in enumerate(starts.tolist()):
            if start - before >= size:
                times = Counter(row[start:start + size])
                total = sum(n * n * squared[w] for w, n in times.items())
            else:
                for w in row[before:start]:
                    total -= (2 * times[w] - 1) * squared[w]
                    times[w] -= 1
                for w in row[before + size:start + size]:
                    total += (2 * times[w] + 1) * squared[w]
                    times[w] += 1
            out[k], before = total, start
        return out

    def best(self, ids: np.ndarray, full: bool, among: np.ndarray) -> tuple[float, int, int, int] | None:
        """Cosine, start, end and template of the nearest run to the full texts, or to the notices; the first of equals."""
        found = [(*run, int(t)) for t in among if self.full[t] == full and (run := self.nearest(t, ids))]
        return max(found, key=lambda f: (round(f[0], 9), -f[1], -f[3]), default=None)


def build_runs(counts: dict[bytes, int], documents: int) -> Runs:
    """``counts``: in how many documents each word of the templates and full texts occurs."""
    every = [(name, words(t.encode()), False) for name, texts in TEMPLATES.items() for t in texts]
    every += [(name, words(t.encode()), True) for name, t in FULL_TEXTS.items()]
    at = {w: k for k, w in enumerate(sorted({w for _, found, _ in every for w in found}))}
    idf = np.array([log((1 + documents) / (1 + counts.get(w, 0))) + 1 for w in at] + [log(1 + documents) + 1])
    own = np.zeros((len(every), len(idf)))
    for row, (_, found, _) in zip(own, every):
        for w, n in Counter(found).items():
            row[at[w]] = n * idf[at[w]]
        row /= sqrt(row @ row)
    least = np.array([LEAST_FULL if full else LEAST_SHORT if len(found) < SHORT else LEAST for _, found, full in every])
    return Runs([e[0] for e in every], [len(e[1]) for e in every], [e[2] for e in every], at, idf, own, least)


def _word_counts(files: DataFrame) -> tuple[dict[bytes, int], int]:
    """Documents that hold each word of the templates, and all documents: one number for each template word."""
    vocabulary = sorted({w for texts in (*TEMPLATES.values(), FULL_TEXTS.values()) for t in texts for w in words(t.encode())})
    schema = pa.schema([("word", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {w: k for k, w in enumerate(vocabulary)}
        totals, rows = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for text in raw_texts(batch.column(0)):
                totals[[at[w] for w in set(words(text or b"")).intersection(at)]] += 1
        yield from in_batches([(-1, rows), *((k, int(n)) for k, n in enumerate(totals) if n)], schema)

    found = {r.word: r.n for r in files.select("text").mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: found.get(k, 0) for k, w in enumerate(vocabulary)}, found.get(-1, 0)


def _statement(text: bytes, index: Index, runs: Runs, needed: frozenset[bytes], least: float) -> tuple[str, float, bool] | None:
    """Licence, cosine and whether the whole text is the notice, of a text that states a licence.

    The nearest line or run counts, and of equals the first. Notices inside a run that is a full licence text are part of that text.
    """
    every = words(text)
    if not every:
        return None
    lines, ids = not needed.isdisjoint(every), runs.numbers(every)
    among = runs.possible(ids)
    if not lines and not len(among):
        return None
    found: list[tuple[float, int, str]] = []
    whole: tuple[str | None, float] = (None, 0.0)
    is_whole = False
    text_run = runs.best(ids, True, among)
    start, end = len(ids), len(ids)
    if text_run:
        cosine, start, end, template = text_run
        found.append((cosine, start, runs.names[template]))
        is_whole = runs.cosine(template, ids) >= runs.least[template]
    if lines:
        at = 0
        for line in text.split(b"\n"):
            held = words(line)
            if not needed.isdisjoint(held) and (at + len(held) <= start or at >= end):
                name, cosine = index.nearest(held)
                found.append((cosine, at, name))
            at += len(held)
        if not text_run:
            whole = index.nearest(every)
            found.append((whole[1], 0, whole[0]))
            is_whole = whole[1] >= least
    for first, piece in ((0, ids[:start]), (end, ids[end:])):
        run = runs.best(piece, False, among) if len(piece) else None
        if run:
            found.append((run[0], first + run[1], runs.names[run[3]]))
    cosine, _, name = max(found, key=lambda f: (round(f[0], 9), -f[1]), default=(0.0, 0, None))
    return (name, cosine, is_whole) if cosine >= least else None


def stated(files: DataFrame, keys: list[str], least: float = LEAST) -> DataFrame:
    """``keys``, ``license``, ``cosine`` and ``whole`` (the whole text is the notice) of every row of ``files`` that states a licence.

    Null and empty texts state nothing. Of several lines and runs the nearest one counts, and of equals the first.
    """
    counted = _word_counts(files)
    index = files.sparkSession.sparkContext.broadcast((build_index(*counted), build_runs(*counted)))
    held = files.select(*keys, "text")
    out = ", ".join(f"`{k}` {held.schema[k].dataType.simpleString()}" for k in keys) + ", license string, cosine double, whole boolean"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, runs = index.value
        needed = own.informative(least)
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(raw_texts(batch.column(len(keys)))):
                statement = _statement(text or b"", own, runs, needed, least)
                if statement:
                    rows.append(row)
                    found.append(statement)
            picked = batch.select(keys).take(pa.array(rows, pa.int64()))
            extra = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*picked.columns, *extra], names=[*keys, "license", "cosine", "whole"])

    return held.mapInArrow(scan, out)


def _directory(path: str) -> F.Column:
    """The part of a path before its last slash; '' at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def inherited(files: DataFrame, licence_files: DataFrame) -> DataFrame:
    """(path, directory, from_directory, inherited) of the distinct paths of ``files`` with a licence file in their directory or one above.

    ``licence_files`` has path, license and cosine; of several in a directory the nearest to its template counts, then the smaller path. The ancestors
    are made for distinct directories only, so a directory of very many files costs one row.
    """
    held = licence_files.select(_directory("path").alias("above"), F.struct(-F.col("cosine"), F.col("path"), F.col("license").alias("license")).alias("s")) \
        .groupBy("above").agg(F.min("s").alias("s")).select("above", F.col("s.license").alias("inherited"))
    held = written(held, "licensed")
    paths = files.where("path is not null").select("path").distinct().withColumn("directory", _directory("path"))
    directories = paths.select("directory").distinct()
    parts = F.split("directory", "/")
    above = F.when(F.col("directory") == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))
    ancestors = directories.select("directory", F.posexplode(above).alias("depth", "above"))
    nearest = ancestors.join(broadcast_if_small(held, 200), "above").groupBy("directory").agg(F.max(F.struct("depth", "above", "inherited")).alias("s"))
    nearest = written(nearest.select("directory", F.col("s.above").alias("from_directory"), "s.inherited"), "inherited")
    return paths.join(broadcast_if_small(nearest, 200), "directory").select("path", "directory", "from_directory", "inherited")


def scan(files: DataFrame, licence_file: str, keys: list[str], least: float = LEAST) -> DataFrame:
    """``keys``, path, stated, cosine, inherited, from_directory and license of every row of ``files`` (keys, path, text).

    ``licence_file`` is a SQL condition that says of a file that states a licence whether it speaks for its directory. ``license`` is what a file states itself, or else what it inherits, or null.
    A row without path states, but inherits nothing. Rows that share all keys and the path are one file: each is returned with the best statement among
    them.
    """
    own = [*keys, "path"]
    found = written(stated(files, own, least), "stated")
    by_file = found.groupBy(*own).agg(F.max(F.struct("cosine", "license", "whole")).alias("s")).select(*own, F.col("s.license").alias("stated"), F.col("s.cosine").alias("cosine"), "s.whole")
    speaking = by_file.where(F.col("path").isNotNull()).withColumn("license", F.col("stated")).where(F.expr(licence_file)).select("path", "license", "cosine")
    above = inherited(files, written(speaking, "licence-files")).select(F.col("path").alias("held_path"), "inherited", "from_directory")
    rows = files.select(*own)
    same = F.lit(True)
    named = by_file.select(*[F.col(c).alias(f"stated_{c}") for c in own], "stated", "cosine")
    for c in own:
        same = same & rows[c].eqNullSafe(named[f"stated_{c}"])
    out = rows.join(named, same, "left").select(*own, "stated", "cosine")
    out = out.join(above, out["path"] == above["held_path"], "left")
    return out.select(*own, "stated", "cosine", "inherited", "from_directory", F.coalesce("stated", "inherited").alias("license"))
