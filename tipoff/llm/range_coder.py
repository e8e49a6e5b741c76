"""Token ids in a compressed file format: adaptive context mixing and a range coder.

A file's row (a segment) holds whole documents. Its ids are cut into equal blocks of at most ``BLOCK`` ids, and all blocks of a segment are
coded side by side, one numpy lane each; the last block is filled up with the most frequent id. A block starts from fixed states and has a
checksum of its own, so it can be checked and read alone (``read_block``).

For each id, the block's tables give the id that last followed the two ids before it (order 2) and the one that last followed the id
before it (order 1), each with a count of how often it was right. Where a table has an answer, "Is it the order-2 id?" and, if not, "is it the
order-1 id?" are coded with a chance mixed from three adaptive estimates: by the order-2 count, by the order-1 count, and by recent luck. Weights
learn from every answer. Any other id is coded by order 0: the number of binary digits of its frequency rank, with adaptive
frequencies (renewed every ``RENEW`` ids), and then the digits. All arithmetic is in whole numbers, so that reading repeats writing exactly, and
one loop serves both: a coder that writes is told each answer, one that reads finds it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"IDRC\x02"
#: Ids in a block, and blocks in a full segment.
BLOCK, LANES = 1024, 8192
#: Entries of a block's order-1 and order-2 tables, as a power of two.
SLOT_BITS = 9
#: Ids after which the frequencies of the numbers of digits are renewed.
RENEW = 16
#: Binary digits by which an estimate's change is less than the miss.
RATE = 4
_HEAD = struct.Struct("<5sIIII")  # magic, ids, blocks, distinct ids, ids in a block

_WORD, _16 = np.uint32(1 << 16), np.uint32(16)
_12 = np.uint32(12)  # binary digits of a chance
_DIGITS = 17
#: Largest offset of so many digits, which is also the first rank that has them.
_PLACES = ((1 << np.arange(_DIGITS)) - 1).astype(np.uint32)


#: Chance, of 4096, by the logarithm of its odds (256 for 1), from -2048 on.
_SQUASH = np.clip(np.rint(4096 / (1 + np.exp(-(np.arange(-2048, 2048) / 256)))), 4, 4096 - 4).astype(np.int32)
#: By 2 * count + right: the next count (in the upper half of an entry), and whether the entry keeps its id (in the lower half).
_NEXT = np.array([(min(count + 1, 7) if right else max(count >> 1, 1)) << 16 | (right or count > 1) for count in range(8) for right in (0, 1)], np.uint32)


class _Coder:
    """Range coder of 32-bit ranges and 16-bit words, in every lane at once. ``words`` are row after row, one column a lane."""

    def __init__(self, lanes: int, words: np.ndarray):
        self.range = np.full(lanes, 0xFFFFFFFF, np.uint32)
        self.words, self.lanes = words.reshape(-1), lanes
        self.each = np.arange(lanes)
        self.at = self.each.copy()

    def grow(self, lanes: np.ndarray | None = None) -> None:
        """Of the given lanes, or all, those whose range is below a word move on by one."""
        move = (self.range < _WORD).nonzero()[0] if lanes is None else lanes[self.range.take(lanes) < _WORD]
        if len(move):
            at = self.at.take(move)
            self.shift(move, at)
            self.at[move] = at + self.lanes
            self.range[move] = self.range.take(move) << _16


    def no(self, chance: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """What a no takes of the ranges; nothing where none was asked."""
        no = self.range >> _12
        no *= chance
        np.subtract(self.range, no, out=no)
        no *= asked
        return no

    def narrow(self, steps: np.ndarray, literal: np.ndarray, digits: np.ndarray) -> np.ndarray:
        """The ranges of the numbers of digits, where there are any; returns where they begin."""
        cell = self.each + digits * self.lanes
        unit = self.range >> _12
        start = steps.take(cell).astype(np.uint32)
        cell += self.lanes
        size = steps.take(cell) - start
        size *= unit
        np.copyto(self.range, size, where=literal)
        unit *= start
        unit *= literal
        return unit


class _Writer(_Coder):
    """A word may carry over into the one before it: it is kept above 16 bits until the end."""

    def __init__(self, lanes: int, block: int):
        super().__init__(lanes, np.zeros((3 * block + 4, lanes), np.uint32))  # pages that are not reached take no memory
        self.low = np.zeros(lanes, np.uint64)

    def shift(self, lanes: np.ndarray, at: np.ndarray) -> None:
        low = self.low.take(lanes)
        self.words[at] = low >> np.uint64(16)
        self.low[lanes] = (low & np.uint64(0xFFFF)) << np.uint64(16)

    def answer(self, chance: np.ndarray, asked: np.ndarray, yes: np.ndarray) -> np.ndarray:
        no = self.no(chance, asked)
        self.range -= no
        miss = asked & ~yes
        self.low += self.range * miss
        np.copyto(self.range, no, where=miss)
        self.grow()
        return yes

    def answer_some(self, lanes: np.ndarray, chance: np.ndarray, yes: np.ndarray) -> np.ndarray:
        span = self.range.take(lanes)
        cut = (span >> _12) * chance
        self.low[lanes] += cut * ~yes
        self.range[lanes] = np.where(yes, cut, span - cut)
        self.grow(lanes)
        return yes

    def digits(self, steps: np.ndarray, literal: np.ndarray, digits: np.ndarray) -> np.ndarray:
        self.low += self.narrow(steps, literal, digits)
        self.grow()
        return digits

    def offset(self, digits: np.ndarray, offset: np.ndarray) -> np.ndarray:
        self.range >>= digits
        self.low += self.range * offset
        self.grow()
        return offset

    def finish(self) -> list[bytes]:
        for _ in range(2):
            self.shift(self.each, self.at)
            self.at += self.lanes
        counts = self.at // self.lanes
        words = self.words.reshape(-1, self.lanes)[:counts.max()]
        for k in range(len(words) - 1, 0, -1):
            words[k - 1] += words[k] >> _16
        rows = np.ascontiguousarray(words.astype("<u2").T)
        return [row[:n].tobytes() for row, n in zip(rows, counts)]


class _Reader(_Coder):
    def __init__(self, payloads: list[bytes]):
        rows = np.zeros((len(payloads), max(map(len, payloads)) // 2 + 2), "<u2")
        for row, payload in zip(rows, payloads):
            row[:len(payload) // 2] = np.frombuffer(payload, "<u2", len(payload) // 2)
        super().__init__(len(payloads), np.ascontiguousarray(rows.T.astype(np.uint32)))
        self.last = len(self.words) - 1
        self.code = self.words[:self.lanes] << _16 | self.words[self.lanes:2 * self.lanes]
        self.at += 2 * self.lanes

    def shift(self, lanes: np.ndarray, at: np.ndarray) -> None:
        self.code[lanes] = self.code.take(lanes) << _16 | self.words.take(at, mode="clip")  # a damaged block may ask for more words

    def answer(self, chance: np.ndarray, asked: np.ndarray, yes: None) -> np.ndarray:
        no = self.no(chance, asked)
        self.range -= no
        miss = self.code >= self.range
        miss &= asked
        self.code -= self.range * miss
        np.copyto(self.range, no, where=miss)
        self.grow()
        return asked & ~miss

    def answer_some(self, lanes: np.ndarray, chance: np.ndarray, yes: None) -> np.ndarray:
        span, code = self.range.take(lanes), self.code.take(lanes)
        cut = (span >> _12) * chance
        yes = code < cut
        self.code[lanes] = code - cut * ~yes
        self.range[lanes] = np.where(yes, cut, span - cut)
        self.grow(lanes)
        return yes

    def digits(self, steps: np.ndarray, literal: np.ndarray, digits: None) -> np.ndarray:
        part = np.minimum(self.code // (self.range >> _12), np.uint32(4095)).astype(np.uint16)
        digits = np.add.reduce((steps[1:-1] <= part).view(np.int8), axis=0, dtype=np.int8).astype(np.int64)
        self.code -= self.narrow(steps, literal, digits)
        self.grow()
        digits *= literal
        return digits

    def offset(self, digits: np.ndarray, offset: None) -> np.ndarray:
        """The rank, from 0."""
        self.range >>= digits.astype(np.uint32)
        offset = self.code // self.range
        places = _PLACES.take(digits)
        np.minimum(offset, places, out=offset)
        self.code -= self.range * offset
        self.grow()
        offset += places
        return offset


class _Mixer:
    """Yes or no answers, from three adaptive estimates with learned weights. An estimate is the logarithm of the odds in a context."""

    CONTEXTS = 16
    MOST = 300_000

    def __init__(self, lanes: int):
        self.odds = np.zeros(3 * lanes * self.CONTEXTS, np.int16)
        self.weight = np.full((3, lanes), 22_000, np.int32)

    def predict(self, cells: np.ndarray, lanes: np.ndarray | None = None) -> np.ndarray:
        """Chance of yes, of 4096, in the given lanes or all. ``cells``: the place of each estimate in its context."""
        self.at, self.cells = lanes, cells
        self.weights = self.weight if lanes is None else self.weight.take(lanes, 1)
        self.now = self.odds.take(self.cells).astype(np.int32)
        total = np.add.reduce(self.weights * self.now, 0, np.int32)
        total >>= 16
        total += 2048
        self.said = _SQUASH.take(total, mode="clip")
        return self.said.view(np.uint32)

    def learn(self, yes: np.ndarray, asked: np.ndarray | None = None) -> None:
        """The answers of the lanes that were asked."""
        miss = yes.astype(np.int32)
        miss <<= 12
        miss -= self.said
        if asked is not None:
            miss *= asked
        self.odds[self.cells] = (self.now + (miss >> RATE)).astype(np.int16)
        self.now *= miss
        self.now += 2048
        self.now >>= 12
        if self.at is None:
            self.weight += self.now
        else:
            self.weights += self.now
            for weight, weights in zip(self.weight, self.weights):
                weight[self.at] = weights

    def bound(self) -> None:
        """Sums stay within 32 bits, if this is done every few answers."""
        np.minimum(self.weight, self.MOST, out=self.weight)
        np.maximum(self.weight, -self.MOST, out=self.weight)


class _Digits:
    """Adaptive frequencies of the numbers of digits: ``steps`` has the sum of those of fewer digits, of 4096."""

    FULL = 1 << 20
    LEAST = 1 << 10
    RATES = 4, 6  # binary digits by which a change is less than the miss, at first and in the end

    def __init__(self, lanes: int):
        self.grid = np.arange(_DIGITS + 1, dtype=np.int32)[:, None]
        self.sums = np.repeat(self.grid * (self.FULL // _DIGITS), lanes, 1)
        self.sums[-1] = self.FULL
        self.seen = np.full((RENEW, lanes), _DIGITS, np.uint8)  # the last numbers of digits, ``_DIGITS`` for ids that had none
        self.n = 0
        self.rate = self.RATES[0]
        self.steps = (self.sums >> 8).astype(np.uint16)

    def learn(self, digits: np.ndarray, literal: np.ndarray) -> bool:
        """The numbers of digits of one row; returns whether the frequencies were renewed."""
        self.seen[self.n] = digits
        np.copyto(self.seen[self.n], np.uint8(_DIGITS), where=~literal)
        self.n += 1
        if self.n == RENEW:
            self.n = 0
            below = np.stack([np.add.reduce((self.seen < d).view(np.uint8), 0, np.uint8) for d in range(_DIGITS + 1)]).astype(np.int32)
            change = below * (self.FULL - self.LEAST * _DIGITS) + below[-1] * (self.LEAST * self.grid - self.sums)
            self.sums += change >> self.rate
            self.rate = min(self.rate + 1, self.RATES[1])
            self.steps = (self.sums >> 8).astype(np.uint16)
        return not self.n


def _code(coder: _Writer | _Reader, by_rank: np.ndarray, rows: np.ndarray, of: np.ndarray | None = None) -> None:
    """Writes the ids of ``rows`` (one column a lane), or reads them into it if ``of`` is not given: by id, its
    number of digits and, above 5 bits, what they leave of its frequency rank."""
    lanes, reads = rows.shape[1], of is None
    base = (np.arange(2)[:, None] * lanes + np.arange(lanes)) << SLOT_BITS
    entries = np.zeros(2 * lanes << SLOT_BITS, np.uint32)  # order 1, order 2: id and, above it, count
    mixers, frequencies = (_Mixer(lanes), _Mixer(lanes)), _Digits(lanes)
    truth, before, luck = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32), np.zeros(lanes, np.int64)
    hashed, contexts = np.empty((2, lanes), np.uint32), np.empty((3, lanes), np.int64)
    places = np.arange(3 * lanes).reshape(3, lanes) * _Mixer.CONTEXTS
    right = offset = digits = yes = None
    for row in rows:
        mixed = truth * np.uint32(2654435769)
        hashed[0] = mixed
        np.multiply(mixed ^ before, np.uint32(2246822519), out=hashed[1])
        before = mixed >> np.uint32(7)
        hashed >>= np.uint32(32 - SLOT_BITS)
        cells = base + hashed
        entry = entries.take(cells)
        guess, count = entry & np.uint32(0xFFFF), entry >> _16
        known, agree = count.astype(bool), guess[0] == guess[1]
        count <<= np.uint32(1)
        np.bitwise_or(count, agree, out=contexts[:2])
        contexts[2] = luck
        contexts += places
        likely = (guess[1] - guess[0]) * known[1] + guess[0]
        asked = known[0] | known[1]
        if not reads:
            truth = row.astype(np.uint32)
            yes = likely == truth
            yes &= asked
            digits = of.take(row)
            offset = digits >> np.uint32(5)
            digits &= np.uint32(31)

        found = coder.answer(mixers[0].predict(contexts), asked, yes)
        mixers[0].learn(found, asked)
        literal = ~found
        some = (known[0] & known[1] & ~agree & literal).nonzero()[0]
        if len(some):
            others = guess[0].take(some)
            yes = None if reads else others == truth.take(some)
            yes = coder.answer_some(some, mixers[1].predict(contexts.take(some, 1), some), yes)
            mixers[1].learn(yes)
            some, others = some[yes], others[yes]
            literal[some] = False
        if not reads:
            digits *= literal
        digits = coder.digits(frequencies.steps, literal, digits)
        if frequencies.learn(digits, literal):
            for mixer in mixers:
                mixer.bound()
        if not reads:
            offset *= literal
        offset = coder.offset(digits, offset)
        if reads:
            truth = by_rank.take(offset, mode="clip")
            np.copyto(truth, likely, where=found)
            if len(some):
                truth[some] = others
            row[:] = truth

        count |= guess == truth
        change = _NEXT.take(count)
        guess -= truth
        guess *= change & np.uint32(1)
        guess += truth
        guess += change & np.uint32(7 << 16)
        entries[cells] = guess
        luck <<= 1
        luck |= ~literal
        luck &= 15


def write_segment(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """The ids (below 65,536) as one segment."""
    n = len(ids)
    lanes = -(-n // block)
    block = -(-n // lanes) if n else 0
    counts = np.bincount(ids, minlength=1 << 16)
    by_rank = np.argsort(-counts, kind="stable")[:np.count_nonzero(counts)].astype("<u2")
    cells = np.full(lanes * block, by_rank[0] if n else 0, "<u4")
    cells[:n] = ids
    grid = cells.reshape(lanes, block)
    payloads = _write_lanes(grid, by_rank) if n else []
    table = np.array([[len(p), zlib.crc32(row)] for p, row in zip(payloads, grid)], "<u4").tobytes()
    return b"".join([_HEAD.pack(MAGIC, n, lanes, len(by_rank), block), by_rank.tobytes(), table, *payloads])


def _write_lanes(grid: np.ndarray, by_rank: np.ndarray) -> list[bytes]:
    lanes, block = grid.shape
    ranks = np.arange(1, len(by_rank) + 1)
    digits = np.frexp(ranks.astype(float))[1] - 1  # binary digits after the first
    of = np.zeros(1 << 16, np.uint32)
    of[by_rank] = (ranks - (1 << digits)) << 5 | digits
    coder = _Writer(lanes, block)
    _code(coder, by_rank, np.ascontiguousarray(grid.T.astype(np.uint16)), of)
    return coder.finish()


def _open(data: bytes) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """Number of ids, ids in a block, ids by rank, and of each block its checksum and where its bytes begin and end."""
    magic, n, lanes, distinct, block = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment of ids")
    by_rank = np.frombuffer(data, "<u2", distinct, _HEAD.size).astype(np.uint32)
    table = np.frombuffer(data, "<u4", 2 * lanes, _HEAD.size + 2 * distinct).reshape(-1, 2).astype(np.int64)
    ends = _HEAD.size + 2 * distinct + 8 * lanes + np.cumsum(table[:, 0])
    return n, block, by_rank, table[:, 1], np.stack([ends - table[:, 0], ends], 1)


def _read_blocks(data: bytes, numbers: range, block: int, by_rank: np.ndarray, checks: np.ndarray, places: np.ndarray) -> np.ndarray:
    rows = np.zeros((block, len(numbers)), np.uint16)
    _code(_Reader([data[slice(*places[k])] for k in numbers]), by_rank, rows)
    grid = np.ascontiguousarray(rows.T).astype("<u4")
    for k, row in zip(numbers, grid):
        if zlib.crc32(row) != checks[k]:
            raise ValueError(f"block {k} of the segment is damaged")
    return grid.reshape(-1)


def read_segment(data: bytes) -> np.ndarray:
    """The ids of a segment, after each block's checksum was found right."""
    n, block, by_rank, checks, places = _open(data)
    return _read_blocks(data, range(len(checks)), block, by_rank, checks, places)[:n] if n else np.zeros(0, "<u4")


def read_block(data: bytes, k: int) -> np.ndarray:
    """The ids of one block of a segment, without reading the others."""
    n, block, by_rank, checks, places = _open(data)
    return _read_blocks(data, range(k, k + 1), block, by_rank, checks, places)[:n - k * block]
