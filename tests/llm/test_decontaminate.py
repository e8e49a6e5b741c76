import random
import re

from tipoff.llm.decontaminate import Searcher, find_windows, hit_report, without_hits, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text, items, window=10):
    found, hit, named = WORD.findall(lower(text)), set(), set()
    for item, item_text in items:
        ids = WORD.findall(lower(item_text))
        size = min(window, len(ids))
        for k in range(len(ids) - size + 1 if ids else 0):
            for p in range(len(found) - size + 1):
                if found[p:p + size] == ids[k:k + size]:
                    hit.update(range(p, p + size))
                    named.add(str(item))
    return len(found), len(hit), sorted(named)


def test_words_are_the_contract_s():
    text = "Ab-c9_É x ÀB\x00y `z{~"
    assert [w.decode() for w in words(text.encode())] == WORD.findall(lower(text))


def test_search_equals_comparison_of_all_positions():
    rng = random.Random(3)
    for _ in range(60):
        vocabulary = [f"v{k}" for k in range(rng.choice([2, 3, 30]))]
        items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 9, 10, 11, 25])))) for k in range(6)]
        text = " ".join(rng.choices(vocabulary + ["other"], k=80)) + " " + items[3][1] + " " + items[5][1]
        n, hit, named = brute(text, items)
        found = words(text.encode())
        spans, holders = Searcher([(str(i), t.encode()) for i, t in items], 10).search(found)
        assert (len(found), len({w for a, k in spans for w in range(a, a + k)}), sorted(holders)) == (n, hit, named)


def test_report_over_chunks_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr("tipoff.llm.decontaminate.CHUNK_BYTES", 60)
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "short item"), (10, "Short  ITEM"), (3, None), (4, ""),
             (None, "nameless words here"), (2, "short item")]
    texts = [(1, "zero ONE two three four five six seven eight nine ten eleven and a short-item"), (2, None), (3, ""), (3, "nameless words here"),
             (None, "short item " * 3000), (4, "one two three four five six seven eight nine")]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in texts], "doc_id long, text string, items string, n_words string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    out = hit_report(find_windows(docs.select("doc_id", "text"), benchmark)).collect()
    named = [(i, t) for i, t in items if i is not None]
    import hashlib

    for row, (doc_id, text) in zip(sorted(out, key=lambda r: (r.doc_id or 0, r.n_words)), sorted(texts, key=lambda r: (r[0] or 0, len(r[1] or "")))):
        n, hit, ids = brute(text, named)
        if text == "nameless words here":
            hit = 3
        assert (row.doc_id, row.n_words, row.n_hit, row.n_items, row.contaminated) == (doc_id, n, hit, len(ids), hit > 0)
        assert row.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
    clean = without_hits(docs, benchmark)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id, r["items"]) for r in clean.collect()) == [(2, "a"), (3, "a"), (4, "a")]
    assert without_hits(docs, benchmark.where("false")).count() == len(texts)
    assert without_hits(docs.where("false"), benchmark).count() == 0
