import random
import textwrap
from collections import Counter
from math import sqrt


from tipoff.llm.decontaminate import words
from tipoff.llm.licence_texts import FULL_TEXTS
from tipoff.llm.licenses import LEAST, TEMPLATES, build_index, build_runs, scan

LICENCE_FILE = "path rlike '(^|/)LICENSE[^/]*$'"


def dense(index, text):
    """Cosines to all templates over plain vectors."""
    weigh = lambda found: {w: n * index.idf.get(w, index.unknown) for w, n in Counter(found).items()}
    unit = lambda v: {w: x / sqrt(sum(y * y for y in v.values())) for w, x in v.items()}
    own = unit(weigh(words(text.encode()))) if words(text.encode()) else {}
    every = [(name, unit(weigh(words(t.encode())))) for name, texts in TEMPLATES.items() for t in texts]
    return [(name, sum(x * own.get(w, 0) for w, x in v.items())) for name, v in every]


def test_sparse_cosine_equals_dense_and_needed_words_lose_nothing():
    rng = random.Random(1)
    index = build_index({b"the": 900, b"of": 800, b"license": 5, b"this": 300}, 1000)
    needed = index.informative(LEAST)
    assert needed and b"the" not in needed
    vocabulary = [w.decode() for w in index.idf] + ["other", "words"]
    texts = [t for ts in TEMPLATES.values() for t in ts] + [" ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 12]))) for _ in range(500)]
    for text in texts:
        best = max(c for _, c in dense(index, text))
        name, cosine = index.nearest(words(text.encode()))
        assert abs(cosine - best) < 1e-9
        if best >= LEAST:
            assert not needed.isdisjoint(words(text.encode()))


def test_own_and_nearest_ancestor(spark):
    mit, apache, nc = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0."
    body = "some words here\nand more words of the text\n"
    rows = [
        (1, "LICENSE", mit), (2, "a/LICENSE", body + apache), (3, "a/b/c/file.txt", body), (4, "a/b/own.txt", nc + "\n" + body), (5, "z/q.txt", body),
        (6, "a/x/LICENSE-1", nc), (7, "a/x/LICENSE-2", nc), (8, "a/x/f", body * 3000), (9, "ab/f", None), (10, None, mit), (11, None, None),
        (12, "a/LICENSE/f", ""), (12, "a/LICENSE/f", mit), (None, "a/n", body), (13, "top", body), (14, "b/LICENSE", body),
    ]
    files = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, path string, text string, cosine double, license string")
    out = scan(files, LICENCE_FILE, ["doc_id"]).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert [(by[k].license, by[k].from_directory) for k in (1, 2, 3, 4, 5)] == [
        ("MIT", ""), ("Apache-2.0", "a"), ("Apache-2.0", "a"), ("CC-BY-NC-4.0", "a"), ("MIT", "")]
    assert by[4].inherited == "Apache-2.0" and by[8].license == "CC-BY-NC-4.0" and by[8].from_directory == "a/x"
    assert by[9].license == "MIT" and by[10].license == "MIT" and by[11].license is None
    assert {r.license for r in out if r.doc_id == 12} == {"MIT"} and by[None].license == "Apache-2.0" and by[13].license == by[14].license == "MIT"
    assert scan(files.where("false"), LICENCE_FILE, ["doc_id"]).count() == 0


CODE = "".join(f"def step_{k}(x, y):\n    total = x * {k} + y  # adds part {k}\n    return total\n\n" for k in range(400))


def commented(text, mark, width):
    return "".join(f"{mark} {line}".rstrip() + "\n" for line in textwrap.wrap(text, width))


def test_wrapped_headers_and_full_texts(spark):
    gpl3, apache = TEMPLATES["GPL-3.0"][1], TEMPLATES["Apache-2.0"][1]
    years = "Copyright (c) 2021 Some Body. All rights reserved. "
    want = {name: name for name in FULL_TEXTS}  # complete licence files, under a copyright line of their own
    texts = {name: f"{years}\n\n{text}" for name, text in FULL_TEXTS.items()}
    for name, licence, text in [
        ("gpl3 header", "GPL-3.0", commented("This file is part of Foo. " + gpl3, "#", 72) + CODE),
        ("apache header", "Apache-2.0", "/*\n" + commented(years + apache, " *", 60) + " */\n" + CODE),
        ("short wrapped", "Apache-2.0", "// Licensed under the Apache License,\n// Version 2.0.\n" + CODE),
        ("lgpl header", "LGPL-2.1", commented(TEMPLATES["LGPL-2.1"][0], "//", 50) + CODE),
        ("bsd3 above code", "BSD-3-Clause", commented(years + FULL_TEXTS["BSD-3-Clause"], "#", 72) + CODE),
        ("bsd2 below code", "BSD-2-Clause", CODE + commented(FULL_TEXTS["BSD-2-Clause"].replace("HOLDERS", "OWNERS"), "//", 40)),
        ("mit above code", "MIT", commented(years + FULL_TEXTS["MIT"], "--", 72) + CODE),
        ("code", None, CODE), ("talk", None, "The licence of a song is not the song.\nThe MIT is a school and the GPL is a text.\n" + CODE),
    ]:
        want[name], texts[name] = licence, text
    rows = [(name, f"{k}/{name}", text) for k, (name, text) in enumerate(texts.items())] + [(f"n{k}", f"n/{k}", CODE[:2000] + " the of and to in") for k in range(300)]
    rows += [("mit dir", "m/LICENSE", f"MIT License\n\n{years}\n\n{FULL_TEXTS['MIT']}"), ("below", "m/a/b.py", CODE)]
    out = {r.doc_id: r for r in scan(spark.createDataFrame(rows, "doc_id string, path string, text string"), LICENCE_FILE, ["doc_id"]).collect()}
    assert len(out) == len(rows)
    assert {name: out[name].stated for name in want} == want
    assert out["below"].license == "MIT" and out["below"].from_directory == "m" and not any(out[f"n{k}"].license for k in range(300))


def test_runs_equal_plain_cosines():
    rng = random.Random(3)
    runs = build_runs({b"the": 900, b"of": 800, b"license": 5}, 1000)
    vocabulary = [w.decode() for w in runs.at] + ["other"]
    for name, text in [(n, t) for n, ts in TEMPLATES.items() for t in ts]:
        noise = lambda: " ".join(rng.choices(vocabulary, k=rng.choice([0, 5, 60])))
        ids = runs.numbers(words(f"{noise()} {text} {text} {noise()}".encode()))
        for t in runs.possible(ids):
            size = min(runs.sizes[t], len(ids))
            every = [runs.cosine(t, ids[k:k + size]) for k in range(len(ids) - size + 1)]
            found = runs.nearest(t, ids)
            assert (found is None) == (max(every) < runs.least[t])
            assert found is None or abs(found[0] - max(every)) < 1e-9 and found[1] == next(k for k, c in enumerate(every) if c >= max(every) - 1e-9)
