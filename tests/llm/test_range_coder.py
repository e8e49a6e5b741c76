import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tipoff.llm.range_coder import read_block, read_segment, write_segment
from tipoff.llm.token_files import id_report, read_ids, write_ids
from tipoff.llm.tokens import Encoder


@pytest.mark.parametrize("n", [0, 1, 5, 255, 256, 257, 3000])
@pytest.mark.parametrize("kind", ["random", "skewed", "one", "cycle"])
def test_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"random": rng.integers(0, 65536, n), "skewed": rng.zipf(1.3, n) % 50_000, "one": np.full(n, 7), "cycle": np.arange(n) % 13}[kind].astype(np.uint32)
    data = write_segment(ids, 256)
    assert (read_segment(data) == ids).all()
    if kind in ("one", "cycle") and n == 3000:
        assert len(data) < n // 2


def test_damage_is_found():
    ids = np.random.default_rng(1).zipf(1.5, 4000) % 1000
    data = bytearray(write_segment(ids.astype(np.uint32), 512))
    data[-300] ^= 1
    with pytest.raises(ValueError):
        read_segment(bytes(data))
    with pytest.raises(ValueError):
        read_segment(b"other" + bytes(data[5:]))


@pytest.mark.parametrize("segment", [500, 1 << 21])
def test_files_hold_all_ids_in_order(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr("tipoff.llm.token_files.SEGMENT", segment)
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["Alpha", "beta,", "Γάμμα", "zeta9", "it's"], k=rng.choice([0, 1, 30, 900]))) for _ in range(60)] + [None, "", "\x1codd\x1c", "same", "same"]
    rows = [(k * 7 % 101, t, 5) for k, t in enumerate(texts)] + [(None, "no number", 1), (3, "twice", 2), (3, "twice", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(5)
    path = public_tokenizers.path("word_bpe_49k.json")
    write_ids(docs, f"{tmp_path}/ids", path)
    out = sorted(map(tuple, id_report(read_ids(spark, f"{tmp_path}/ids")).collect()), key=lambda r: r[1])
    plain = Tokenizer.from_file(path)
    want = {}
    for doc_id, text, _ in rows:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.setdefault(doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert [r[0] for r in out] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    assert [r[1] for r in out] == np.cumsum([0, *[r[2] for r in out][:-1]]).tolist()
    for doc_id, found in want.items():
        assert sorted(found) == sorted((r[2], r[3]) for r in out if r[0] == doc_id)
    write_ids(docs.where("false"), f"{tmp_path}/none", path)
    assert read_ids(spark, f"{tmp_path}/none").count() == 0


def test_a_block_is_read_alone():
    ids = (np.random.default_rng(2).zipf(1.4, 3000) % 50_000).astype(np.uint32)
    data = write_segment(ids, 256)
    for k in (0, 5, 11):
        assert (read_block(data, k) == ids[250 * k:250 * (k + 1)]).all()
    start = data.index(write_segment(ids, 256)[-200:])
    with pytest.raises(ValueError):  # the last block is damaged, the first is not
        read_block(data[:start] + bytes(200), 11)
    assert (read_block(data[:start] + bytes(200), 0) == ids[:250]).all()


def test_ratio_of_text_like_ids():
    ids = (np.random.default_rng(3).zipf(1.2, 60_000) % 40_000).astype(np.uint32)
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    assert 8 * (len(write_segment(ids)) - 2 * len(share)) / len(ids) < 1.12 * -(share * np.log2(share)).sum()


def _column(encoder: Encoder, texts: list[str | None], end: bytes) -> list[list[int]]:
    found = list(encoder.encode_column(pa.array(texts, pa.string()), end))
    lengths, ids = np.concatenate([n for n, _ in found]), np.concatenate([i for _, i in found])
    return [part.tolist() for part in np.split(ids, np.cumsum(lengths)[:-1])]


def test_a_column_has_the_ids_of_whole_texts(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, rng = Tokenizer.from_file(path), random.Random(4)
    signs = [*"abcXYZ019.,;!?'\"&$<|>-_ \n\t", "é", "É", "ß", "İ", "Σ", "ς", "ﬁ", "e\u0301", "H\u0331", "I\u0307", "\u00ad", "\u200b", "\xa0", "\u2003", "\x1c", "\x85", "中", "🙂", "µ", "ª", "²", "it's", "<|endoftext|>", "  "]
    texts = [None, "", "  ", "WORD word, Word!! word", *("".join(rng.choices(signs, k=rng.randrange(60))) for _ in range(3000))]
    want = [[*plain.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    end = (1).to_bytes(4, "little")
    assert _column(Encoder(path, False), texts, end) == want
    monkeypatch.setattr("tipoff.llm.tokens._CHUNK", 1000)
    assert _column(Encoder(path, False, limit=20_000), texts, end) == want  # words are forgotten again and again


def test_forms_of_a_word_are_learned_once():
    encoder, sent = Encoder(public_tokenizers.path("word_bpe_49k.json"), False), []
    learn = encoder._learn
    encoder._learn = lambda words: (sent.extend(words), learn(words))
    _column(encoder, ["Zörpel zörpel, ZÖRPEL!! zörpel", "Zörpel; zörpel!!"], b"\1\0\0\0")
    assert sorted(sent) == ["!!", ",", ";", "zörpel"]
