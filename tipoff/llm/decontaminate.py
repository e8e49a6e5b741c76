"""Benchmark decontamination: Wu-Manber search for word windows of benchmark items.

The benchmark is cut into chunks of bounded size. Each chunk becomes a set of search tables that is broadcast,
and every document passes each chunk's tables in one map without a shuffle. Words are numbers in the tables;
number 0 stands for every word that no window holds.

Wu-Manber: for windows of m words, the shift table gives for each block of B words its distance from the end
of the window it is nearest to; a block that no window holds lets the search jump m - B + 1 words. A block that ends a window
selects a bucket of windows by that suffix, and a direct comparison confirms the occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.frames import raw_texts
from tipoff.session import written

WINDOW = 10
#: Benchmark text that one set of search tables is built from.
CHUNK_BYTES = 8 << 20

#: Words are runs of ASCII letters and digits and of all characters beyond ASCII.
_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


class WuManber:
    """Search tables over windows of one length."""

    def __init__(self, windows: dict[tuple[int, ...], list[str]], base: int):
        self.length = len(next(iter(windows)))
        self.block = min(2, self.length)
        self.base = base
        self.jump = self.length - self.block + 1
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, list[tuple[list[int], list[str]]]] = {}
        for window, items in windows.items():
            for end in range(self.block, self.length + 1):
                key = self._key(window[end - self.block], window[end - 1])
                distance = self.length - end
                if distance < self.shift.get(key, self.jump):
                    self.shift[key] = distance
            self.buckets.setdefault(self._key(window[-self.block], window[-1]), []).append((list(window), items))

    def _key(self, first: int, last: int) -> int:
        return first * self.base + last if self.block == 2 else last

    def occurrences(self, ids: list[int]) -> Iterator[tuple[int, list[str]]]:
        """Start of each occurrence with the items that hold this window."""
        length, jump, shift, two, base = self.length, self.jump, self.shift, self.block == 2, self.base
        end, n = length - 1, len(ids)
        while end < n:
            last = ids[end]
            key = ids[end - 1] * base + last if two else last
            distance = shift.get(key, jump)
            if distance:
                end += distance
                continue
            start = end - length + 1
            found = ids[start:end + 1]
            for window, items in self.buckets[key]:
                if window == found:
                    yield start, items
            end += 1


class Searcher:
    """All windows of a chunk of the benchmark, one set of tables for each window length."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[int, dict[tuple[int, ...], list[str]]] = {}
        number = self.vocabulary
        for item, text in items:
            ids = [number.setdefault(w, len(number) + 1) for w in words(text)]
            size = min(window, len(ids))
            for k in range(len(ids) - size + 1 if ids else 0):
                holders = windows.setdefault(size, {}).setdefault(tuple(ids[k:k + size]), [])
                if item is not None and item not in holders:
                    holders.append(item)
        self.tables = [WuManber(found, len(number) + 1) for _, found in sorted(windows.items())]

    def search(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(start, length) of every occurrence in these words, and the items that occur."""
        get = self.vocabulary.get
        ids = [get(w, 0) for w in found]
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for table in self.tables:
            for start, holders in table.occurrences(ids):
                spans.append((start, table.length))
                items.update(holders)
        return spans, items


def _chunks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark in pieces of about ``CHUNK_BYTES``, as the driver reads them one by one."""
    texts = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // CHUNK_BYTES) + 1
    for k in range(n):
        part = texts if n == 1 else texts.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(row.item, row.text.encode()) for row in part.distinct().toLocalIterator()]


def find_windows(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                 benchmark_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Adds ``n_words``, ``hit_spans`` (start and number of words, joined and in order) and ``items`` to every document.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.
    Null and empty texts have no words. An item without a number is searched for but not listed. Repeated
    rows are handled one by one; an empty benchmark leaves every document clean. Other columns stay; columns that
    have one of the added names are replaced.
    """
    added = ("n_words", "hit_spans", "items")
    kept = documents.drop(*added)
    df = kept.select("*", F.lit(0).cast("long").alias("n_words"),
                     F.array().cast("array<struct<start:int,length:int>>").alias("hit_spans"),
                     F.array().cast("array<string>").alias("items"))
    tables = None
    for items in _chunks(benchmark, item_col, benchmark_text):
        if tables is not None:  # one chunk's tables are held at a time: what it found is written before the next
            df = written(df, "searched")
            tables.destroy()
        tables = documents.sparkSession.sparkContext.broadcast(Searcher(items, window))
        df = _searched(df, tables, text_col)
    return df


def _searched(df: DataFrame, tables, text_col: str) -> DataFrame:
    """One map over the documents: the spans and items of one chunk join those found so far."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = tables.value
        for batch in batches:
            at = {name: k for k, name in enumerate(batch.schema.names)}
            counts, spans, items = [], [], []
            earlier = zip(raw_texts(batch.column(at[text_col])), batch.column(at["hit_spans"]).to_pylist(),
                          batch.column(at["items"]).to_pylist())
            for text, old_spans, old_items in earlier:
                found = words(text or b"")
                new_spans, new_items = searcher.search(found)
                counts.append(len(found))
                spans.append(_joined([(s["start"], s["length"]) for s in old_spans] + new_spans))
                items.append(sorted(new_items.union(old_items)))
            columns = list(batch.columns)
            for name, values in (("n_words", counts), ("hit_spans", spans), ("items", items)):
                columns[at[name]] = pa.array(values, batch.schema.field(name).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return df.mapInArrow(search, df.schema)


def _joined(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[list[int]] = []
    for start, length in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + length)
        else:
            out.append([start, start + length])
    return [{"start": a, "length": b - a} for a, b in out]


def hit_report(found: DataFrame) -> DataFrame:
    """Counts and a digest of the items from what ``find_windows`` adds."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def without_hits(documents: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents in which no window of the benchmark occurs, with their own columns, whatever they are called."""
    rest = [F.col(f"`{c}`") for c in documents.columns if c != text_col]
    found = find_windows(documents.select(F.col(text_col), F.struct(*rest, F.lit(0)).alias("row")), benchmark, text_col)
    return found.where(F.size("hit_spans") == 0).select(
        *[F.col(text_col) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in documents.columns])
