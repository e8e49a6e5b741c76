import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tipoff.llm.packing import best_fill, pack, piece_report, plan
from tipoff.llm.tokens import Encoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", "one", " lead", "two  spaces\n\n\nand\ttabs \n mixed ", "it's we'll 12 34ab !?", "Ünï  nb sp ́combining á", "Σίσυφος ΣΑΣ",
         "<|endoftext|> a <|startoftext|>", "one <|endoftext|> two", "x<|ENDOFTEXT|>y", "<|endof text|>", "a <| b", "odd\x1cspace \x1f end", "日本語 テキスト 🙂🙂", "x" * 3000, " \n ", "tail \n", "a  b\u0085  c"]


@pytest.mark.parametrize("path,spaces", [(BYTES, True), (WORDS, False)])
def test_ids_equal_those_of_whole_texts(path, spaces):
    plain = Tokenizer.from_file(path)
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choices("ab 1'.\n\tüΣ ", k=60)) for _ in range(300)]
    texts += ["".join(rng.choices(["a", "B", "ü", "́", "1", "'s", ".", ",", "?!", ";", " ", "  ", "\n", "日", "ª", "…"], k=40)) for _ in range(1000)]
    for limit in (50, 3_000, 1_000_000):
        found = Encoder(path, spaces, limit).encode(texts)
        assert [np.frombuffer(f, "<u4").tolist() for f in found] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_fill_is_the_best_subset_sum():
    rng = random.Random(2)
    for _ in range(200):
        room = rng.randrange(1, 40)
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(0, 6))}
        sums = {0}
        for n, k in counts.items():
            sums = {s + n * j for s in sums for j in range(k + 1) if s + n * j <= room}
        used = best_fill(counts, room)
        assert all(k <= counts[n] for n, k in used.items()) and sum(n * k for n, k in used.items()) == max(sums)


@pytest.mark.parametrize("counts", [{700: 1000}, {1023: 5, 1: 5}, {3: 1}, {}, {n: 3 for n in range(1, 1024)}, {513: 999, 2: 7}])
def test_plan_fills_every_window(counts):
    rest, total = Counter(counts), 0
    for windows, room, uses, cut, slack in plan(counts, 1024):
        assert sum(n * k for n, k in uses.items()) + (slack if cut else 0) == room and room & (room - 1) == 0
        for n, k in uses.items():
            rest[n] -= k * windows
        if cut:
            rest[cut] -= windows
            rest[cut - slack] += windows
        assert min(rest.values(), default=0) >= 0
        total += windows * room
    assert total == sum(n * k for n, k in counts.items()) and not any(rest.values())


@pytest.mark.parametrize("pool", [2000, 6 << 20])
def test_pieces_hold_each_id_once_without_padding(spark, monkeypatch, pool):
    monkeypatch.setattr("tipoff.llm.packing.POOL_TOKENS", pool)
    rng = random.Random(4)
    texts = TEXTS + [None] + [" ".join(rng.choices(["alpha", "beta", "gamma", "zeta9"], k=rng.choice([1, 30, 400, 5000]))) for _ in range(80)] + ["same text " * 300] * 40
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, start int, ids int").repartition(3)
    rows = pack(docs, BYTES).collect()
    plain = Tokenizer.from_file(BYTES)
    for doc_id, text in enumerate(texts):
        pieces = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.start)
        assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces][:-1]]).tolist()
        ids = np.frombuffer(b"".join(bytes(r.ids) for r in pieces), "<u4").tolist()
        assert ids == [*plain.encode(text or "", add_special_tokens=False).ids, 0] and {r.doc_tokens for r in pieces} == {len(ids)}
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    short = 0
    for found in by.values():
        found.sort(key=lambda r: r.offset)
        assert [r.offset for r in found] == np.cumsum([0, *[r.length for r in found][:-1]]).tolist()
        size = sum(r.length for r in found)
        assert size <= 1024 and size & (size - 1) == 0
        short += size < 1024
    assert short <= 3 * 10 * (1 + 200_000 // pool)
    assert piece_report(pack(docs.where("false"), BYTES)).count() == 0
    assert pack(spark.createDataFrame([(None, "a"), (None, None), (5, "b"), (5, "b")], "doc_id long, text string"), BYTES).count() >= 4
