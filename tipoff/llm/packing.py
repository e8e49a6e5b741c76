"""Packing of token sequences by minimum bin slack.

Every task packs the documents that it reads, pool by pool, so nothing is shuffled and a lost task is simply run again.
Documents are cut into whole sequences and one remainder. A pool's remainders are known only by their
lengths and counts. For each window, a subset-sum table of bits (bit s: some multiset of the lengths left adds up to s)
gives the fill closest to the capacity, and walking back through the table gives how often each length is used. The same fill
serves as many windows as the counts allow. Where no fill is exact, one piece is cut to close the window. The last
windows of a pool shrink to powers of two, which need no padding.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.frames import in_batches, tidied
from tipoff.llm.tokens import encoder

#: Tokens of remainders that a task holds before it packs them.
POOL_TOKENS = 6 << 20

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

Piece = tuple[int, int, bytes, int]  # doc_id, start, ids, tokens of the document


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How often to use each length, at most ``counts``, so that the sum is as close to ``room`` as can be.

    Longer lengths are tried first. Each step's table is kept until the target is reached, and read backwards.
    """
    mask = (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []  # length, how many together, table before
    reach = 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length)
        together = 1
        while left:
            together = min(together, left)
            steps.append((length, together, reach))
            reach |= (reach << (length * together)) & mask
            left -= together
            together *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, together, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + together
            total -= length * together
    return used


def plan(counts: dict[int, int], capacity: int) -> Iterator[tuple[int, int, dict[int, int], int, int]]:
    """Windows over a multiset of lengths (each at most ``capacity``): (windows, capacity, uses, cut length, cut to).

    ``uses`` is what one window takes whole. If the cut length is not 0, a window also takes the first part, ``cut to`` long, of one
    piece of that length; the rest goes back into the multiset. Every window is filled exactly.
    """
    counts = {n: k for n, k in counts.items() if k}
    total = sum(n * k for n, k in counts.items())
    while total:
        room = capacity
        while room > total:
            room //= 2
        seed = max(counts)
        uses: dict[int, int] = {}
        if seed <= room:
            rest = dict(counts)
            rest[seed] -= 1
            uses = best_fill({n: k for n, k in rest.items() if k and n <= room - seed}, room - seed)
            uses[seed] = uses.get(seed, 0) + 1
        slack = room - sum(n * k for n, k in uses.items())
        cut = 0
        if slack:
            cut = max(n for n, k in counts.items() if k > uses.get(n, 0))
        need = dict(uses)
        if cut:
            need[cut] = need.get(cut, 0) + 1
        windows = min(counts[n] // k for n, k in need.items())
        windows = min(windows, total // room) if room == capacity else 1
        for n, k in need.items():
            counts[n] -= k * windows
            if not counts[n]:
                del counts[n]
        if cut:
            counts[cut - slack] = counts.get(cut - slack, 0) + windows
        total -= windows * room
        yield windows, room, uses, cut, slack


def pack_pool(pieces: list[Piece], capacity: int, first: int) -> Iterator[tuple]:
    """Rows of ``SCHEMA`` for all pieces of a pool; sequences are numbered from ``first``."""
    held: dict[int, deque[Piece]] = {}
    for piece in pieces:
        held.setdefault(len(piece[2]) // 4, deque()).append(piece)
    number = first
    for windows, _, uses, cut, slack in plan({n: len(q) for n, q in held.items()}, capacity):
        for _ in range(windows):
            offset = 0
            for length, times in sorted(uses.items(), reverse=True):
                for _ in range(times):
                    yield _row(held[length].popleft(), number, offset)
                    offset += length
            if cut:
                doc_id, start, ids, tokens = held[cut].popleft()
                yield _row((doc_id, start, ids[:4 * slack], tokens), number, offset)
                held.setdefault(cut - slack, deque()).append((doc_id, start + slack, ids[4 * slack:], tokens))
            number += 1


def _row(piece: Piece, number: int, offset: int) -> tuple:
    doc_id, start, ids, tokens = piece
    return doc_id, start, len(ids) // 4, ids, tokens, number, offset


def pack(documents: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 1024) -> DataFrame:
    """Pieces of all documents' token ids in sequences of at most ``capacity`` (a power of two): doc_id, start, length, ids
    (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text and then ``end_id``; a null or empty text has the end id alone. Repeated rows and
    rows without doc_id are packed like others. A sequence is shorter than ``capacity`` only at a power of two. An empty table has no pieces.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(rows(batches), _ARROW)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        ids_of = encoder(vocabulary, True)
        end = end_id.to_bytes(4, "little")
        number = TaskContext.get().partitionId() << 33
        pool: list[Piece] = []
        pooled = 0
        for batch in batches:
            docs = batch.column(0).to_pylist()
            texts = batch.column(1)
            for at in range(0, len(docs), 256):
                for doc_id, ids in zip(docs[at:at + 256], ids_of.encode([t or "" for t in texts.slice(at, 256).to_pylist()])):
                    ids += end
                    tokens = len(ids) // 4
                    full = tokens // capacity
                    for k in range(full):
                        start = k * capacity
                        yield _row((doc_id, start, ids[4 * start:4 * (start + capacity)], tokens), number, 0)
                        number += 1
                    if tokens % capacity:
                        pool.append((doc_id, full * capacity, ids[4 * full * capacity:], tokens))
                        pooled += tokens % capacity
                    if pooled >= POOL_TOKENS:
                        for row in pack_pool(pool, capacity, number):
                            yield row
                        number = row[5] + 1
                        pool, pooled = [], 0
        yield from pack_pool(pool, capacity, number)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(packed), SCHEMA)


def piece_report(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
