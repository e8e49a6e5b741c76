import hashlib
import random
import re
import time

from tipoff.llm.secrets import BASE, RULES, Rule, find_secrets, masked, secret_report, trigram_query

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KINDS = ["assign", "access", "hex"]


def brute(text):
    """The base spans by the plain definition."""
    text = text or ""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def texts(n):
    rng = random.Random(5)
    parts = ["password", "PassWD", "secret", "token", "api_key", "ApiKey", "=", ":", " = ", '"', "'", " ", "abcdefg", "abcdefgh", "AKIA",
             "AKIA" + "Z9" * 6, "AKIA" + "Q" * 11, "0123456789abcdef" * 2, "f" * 31, "G", "ü", "𝒳", "==", "x", "\n", "ſecret", "toKen"]
    out = ["".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(n)]
    return out + ["token=secret:abcdefgh1", "AKIAAKIA" + "B" * 12, "𝒳 token: '" + "a" * 40 + "' end", None, "", "a" * 50_000, ("tok " * 20_000) + "token=abcdefgh"]


def test_base_spans_equal_the_plain_definition(spark):
    rows = list(enumerate(texts(400)))
    rows += [(3, "password=hunter2hunter2"), (None, "api_key: 'abcdefgh12'")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {(r.doc_id, r.text): [(s["kind"], s["start"], s["end"]) for s in r.spans] for r in find_secrets(df).collect()}
    assert len(found) == len(rows)
    for doc_id, text in rows:
        assert [s for s in found[doc_id, text] if s[0] in KINDS] == brute(text), (doc_id, text)
    for r in secret_report(find_secrets(df.where("doc_id < 50 and doc_id <> 3"))).collect():
        spans = brute(dict(rows[:400])[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in spans) for k in KINDS)


def test_every_match_satisfies_the_trigram_query():
    samples = {"assign": 'PassWord" : "abcdefgh', "access": "AKIA" + "A" * 12, "private_key": "-----BEGIN EC PRIVATE KEY-----", "github": "ghs_" + "a" * 36,
               "slack": "xoxb-0123456789", "web_token": "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9, "url_login": "http://me:pw@host"}
    for rule in RULES:
        clauses = trigram_query(rule.pattern)
        if rule.kind == "hex":
            assert clauses == []
            continue
        text = samples[rule.kind].lower()
        assert re.search(rule.pattern, samples[rule.kind])
        assert any(all(t in text for t in c) for c in clauses), rule
    assert trigram_query("abc[xy]d|zzzz") == [frozenset({"abc", "bcx", "cxd"}), frozenset({"abc", "bcy", "cyd"}), frozenset({"zzz"})]
    assert trigram_query("ab|cdef") == []
    assert trigram_query("(foo)?bar+") == [frozenset({"bar"})] or trigram_query("(foo)?bar+") == []


def test_masking_empty_tables_and_clashing_columns(spark):
    schema = "doc_id long, text string, n_chars long, spans string, kinds string, joined string"
    rows = [(1, "x token=abcdefgh12 AKIA" + "A" * 14 + " y", 40, "s", "k", "j"), (2, "clean", 99, "s", "k", "j"), (3, None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    out = {r.doc_id: r for r in masked(find_secrets(df)).collect()}
    assert (out[1].text, out[1].n_chars, out[1].kinds, out[1].joined) == ("x [secret] [secret] y", 21, "k", "j")
    assert (out[2].text, out[2].n_chars, out[3].text) == ("clean", 99, None)
    assert find_secrets(df.where("false")).count() == 0
    assert secret_report(find_secrets(df)).count() == 3
    assert find_secrets(df, (Rule("digits", "[0-9]{3}"),)).count() == 3


def plain_mask(text, spans):
    out, at = [], 0
    for start, end in spans:
        if start > at or not out:
            out.append(text[at:start])
        at = max(at, end)
    return "[secret]".join([*out, text[at:]])


def test_texts_with_very_many_spans(spark):
    """Spans and masking are about linear in a text's spans: a text of 1 MB with 30,000 secrets takes seconds."""
    rng = random.Random(3)
    hexes = " ".join("%032x" % rng.getrandbits(128) for _ in range(30_000))
    mixed = "".join(rng.choice(["ü", " ", "token=abcdefgh%d" % rng.randrange(99), "AKIA" + "Z" * 14, "0" * 40, "secret: token=%032x" % rng.getrandbits(120)]) for _ in range(3_000))
    edge = {n: " ".join(["f" * 32] * n) for n in (1, 255, 256, 257, 512, 513)}
    texts = {0: hexes, 1: mixed, 2: "f" * 32 + "x", **{100 + n: x for n, x in edge.items()}}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    started = time.time()
    found = {r.doc_id: r.spans for r in find_secrets(df, BASE).collect()}
    out = {r.doc_id: r.text for r in masked(find_secrets(df, BASE)).collect()}
    assert time.time() - started < 90
    for doc_id, text in texts.items():
        spans = brute(text)
        assert [(s["kind"], s["start"], s["end"]) for s in found[doc_id]] == spans
        assert out[doc_id] == plain_mask(text, [(a, b) for _, a, b in spans])
