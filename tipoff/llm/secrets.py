"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is turned, on the driver, into a Boolean query over three-letter pieces that every match
must hold. The index has a posting (trigram, doc_id) for each of the queries' trigrams that a document holds. A rule's
candidates are the documents found by intersecting the postings of one of its clauses; a rule without mandatory trigrams has every document
as a candidate. Candidates are verified with the expression itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product
from re import _parser as _regex

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipoff.llm.frames import broadcast_if_small, fresh
from tipoff.session import written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: an expression, and the least length of one of its groups in matches that count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base kinds, in their order for equal starts.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Further kinds with a fixed public shape.
FURTHER = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._-]+:[^\x00-\x20/@]+@"),
)
RULES = BASE + FURTHER

#: More alternatives than this for a stretch of an expression count as "anything".
MOST = 64
#: Spans of a text that are handled together.
CHUNK = 256

Clause = frozenset[str]


def trigram_query(pattern: str) -> list[Clause]:
    """The Boolean query of an expression: one of the clauses has all its trigrams (in lower case) in any text that matches.

    An empty list: nothing is mandatory, so every text has to be read.
    """
    clauses = [frozenset()]
    for stretch in _stretches(list(_regex.parse(pattern))):
        options = {frozenset(s[k:k + 3] for k in range(len(s) - 2)) for s in stretch}
        if len(options) and all(options):
            options = {o for o in options if not any(p < o for p in options)}
            if len(clauses) * len(options) <= MOST:
                clauses = [c | o for c, o in product(clauses, options)]
    return sorted(set(clauses), key=sorted) if all(clauses) else []


def _stretches(nodes: list) -> list[list[str]]:
    """The alternatives of each stretch of fixed letters, in the order of the expression."""
    out: list[list[str]] = []
    now = [""]
    for kind, value in nodes:
        options, inner = _options(str(kind), value)
        if options is not None and len(now) * len(options) <= MOST:
            now = [a + b for a, b in product(now, options)]
            continue
        out += [now, *inner]
        now = [""]
    return [*out, now]


def _options(kind: str, value) -> tuple[list[str] | None, list[list[str]]]:
    """All strings that a part can match, if they are few; else the stretches that its matches must hold."""
    if kind == "LITERAL":
        return [chr(value).lower()], []
    if kind == "SUBPATTERN":
        stretches = _stretches(list(value[3]))
        return (stretches[0], []) if len(stretches) == 1 else (None, stretches)
    if kind == "BRANCH":
        each = [_stretches(list(b)) for b in value[1]]
        if all(len(s) == 1 for s in each):
            found = [x for s in each for x in s[0]]
            return (found, []) if len(found) <= MOST else (None, [])
        return None, []
    if kind == "IN" and all(str(k) == "LITERAL" for k, _ in value) and len(value) <= 8:
        return sorted({chr(v).lower() for _, v in value}), []
    if kind == "MAX_REPEAT":
        low, high, part = value
        stretches = _stretches(list(part))
        if (low, high) == (0, 1) and len(stretches) == 1:
            return ["", *stretches[0]], []
        if low == high and low <= 8 and len(stretches) == 1 and len(stretches[0]) == 1:
            return [stretches[0][0] * low], []
        return None, stretches if low else []
    return None, []


def postings(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index (trigram, doc_id) of all trigrams that the rules' queries ask for."""
    asked = sorted({t for r in rules for clause in trigram_query(r.pattern) for t in clause})
    lower = documents.where("doc_id is not null and text is not null").select("doc_id", F.lower("text").alias("text"))
    held = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(t)), F.lit(t)) for t in asked])) if asked else F.array().cast("array<string>")
    return lower.select("doc_id", F.explode(held).alias("trigram")).select("trigram", "doc_id")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, kinds): the rules of which a clause has all its postings, for documents that have any."""
    clauses = [(k, r.kind, sorted(c)) for k, (r, c) in enumerate((r, c) for r in rules for c in trigram_query(r.pattern))]
    entries = [F.struct(F.lit(k).alias("clause"), F.lit(kind).alias("kind"), F.lit(t).alias("trigram"), F.lit(len(c)).alias("size"))
               for k, kind, c in clauses for t in c]
    if not entries:
        return index.where("false").select("doc_id", F.array().cast("array<string>").alias("kinds"))
    asked = index.sparkSession.range(1).select(F.inline(F.array(*entries)))
    met = (index.join(F.broadcast(asked), "trigram").groupBy("doc_id", "clause", "kind", "size")
           .agg(F.count_distinct("trigram").alias("n")).where("n = size"))
    return met.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _matches(rule: Rule, text: Column) -> Column:
    """The spans (start, end, kind) of the rule's leftmost non-overlapping matches, without those too short.

    ``split`` and ``regexp_extract_all`` walk over the same matches, so lengths of the texts between matches and of matches
    add up to places.
    """
    pattern = F.lit(rule.pattern)
    between = F.split(text, rule.pattern, -1)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    counted = found if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    parts = F.arrays_zip(between.alias("gap"), found.alias("whole"), counted.alias("part"))
    parts = F.transform(F.filter(parts, lambda p: p["whole"].isNotNull()), lambda p: F.struct(
        F.length(p["gap"]).alias("gap"), F.length(p["whole"]).alias("n"), (F.length(p["part"]) >= rule.least).alias("kept")))

    def placed(p: Column) -> Column:
        before = _scanned(F.transform(p, lambda x: x["gap"] + x["n"]), lambda a, b: a + b, 0)
        spans = F.zip_with(p, before, lambda x, at: F.struct(
            (at + x["gap"]).alias("start"), (at + x["gap"] + x["n"]).alias("end"), F.lit(rule.kind).alias("kind"), x["kept"].alias("kept")))
        return F.transform(F.filter(spans, lambda x: x["kept"]), lambda x: F.struct(x["start"], x["end"], x["kind"]))

    return _let(parts, placed)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _in_chunks(values: Column) -> Column:
    """The array as an array of arrays of at most ``CHUNK`` entries."""
    last = F.greatest(F.floor((F.size(values) - 1) / CHUNK).cast("int"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(values, c * CHUNK + 1, CHUNK))


def _scanned(values: Column, combine: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each whole number, all before it combined. Arrays grow within chunks only, so the work is about ``CHUNK`` steps an entry."""

    def local(part: Column, start: Column) -> Column:
        return F.aggregate(part, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), lambda a, v: F.struct(
            combine(a["at"], v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

    def by_chunk(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(zero), combine))
        return F.flatten(F.zip_with(chunks, local(totals, F.lit(zero)), local))

    return _let(values, lambda v: _let(_in_chunks(v), by_chunk))


def find_secrets(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``spans``: (start, end, kind) in code points, end exclusive, by start and then in the rules' order.

    Null and empty texts have none. Rows with the same doc_id share their postings and are verified one by one; rows
    without doc_id are always verified. Other columns stay, whatever they are called; a column ``spans`` is replaced.
    """
    documents = documents.drop("spans")
    kinds = fresh("kinds", documents.columns)
    always = [r.kind for r in rules if not trigram_query(r.pattern)]
    found = written(candidates(written(postings(documents.select("doc_id", "text"), rules), "trigrams"), rules), "candidates").withColumnRenamed("kinds", kinds)
    flagged = documents.join(broadcast_if_small(found, 200), "doc_id", "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = []
    for rule in rules:
        test = text.rlike(rule.pattern) if rule.kind in always else F.col("doc_id").isNull() | F.array_contains(kinds, rule.kind)
        spans.append(F.when(test, _matches(rule, text)).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string>>")))
    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(k))])
    ranked = F.transform(F.concat(*spans), lambda s: F.struct(s["start"], F.element_at(order, s["kind"]).alias("rank"), s["end"], s["kind"]))
    sorted_spans = F.transform(F.array_sort(ranked), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return flagged.withColumn("spans", sorted_spans).select(*[F.col(f"`{c}`") for c in documents.columns], "spans")


def _line(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def secret_report(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans and all spans as text, from what ``find_secrets`` adds."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(_line(base), 256).alias("base_sha256"), _line(F.col("spans")).alias("spans"))


def masked(found: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every span of ``find_secrets`` replaced by ``mark``; ``n_chars`` follows, if there is one.

    Overlapping spans become one mark. Documents without spans keep their text and ``n_chars`` as they are.
    """
    text = F.col("text")

    def pieces_of(spans: Column) -> Column:
        """What lies between the spans, (start, end): a span that starts behind the ends of all before it ends a piece."""
        seen = _scanned(spans["end"], lambda a, b: F.greatest(a, b), -1)
        behind = F.zip_with(spans, seen, lambda s, m: F.struct(F.greatest(m, F.lit(0)).alias("start"), s["start"].alias("end"), (m < s["start"]).alias("open")))
        inner = F.transform(F.filter(behind, lambda p: p["open"]), lambda p: F.struct(p["start"], p["end"]))
        return F.concat(inner, F.array(F.struct(F.array_max(spans["end"]).alias("start"), F.length(text).alias("end"))))

    def cut(pieces: Column) -> Column:
        """A chunk of pieces is cut out of the text at once, its pieces out of that."""
        def of_chunk(chunk: Column) -> Column:
            base = F.get(chunk, F.lit(0))["start"]
            whole = F.struct(base.alias("base"), text.substr(base + 1, F.element_at(chunk, -1)["end"] - base).alias("text"))
            return _let(whole, lambda w: F.transform(chunk, lambda p: w["text"].substr(p["start"] - w["base"] + 1, p["end"] - p["start"])))

        return F.flatten(F.transform(_in_chunks(pieces), of_chunk))

    new = F.when(F.size("spans") > 0, F.array_join(_let(pieces_of(F.col("spans")), cut), mark)).otherwise(text)
    columns = [c for c in found.columns if c != "spans"]
    covered = fresh("masked", found.columns)
    out = found.withColumn(covered, new)

    def value(c: str) -> Column:
        if c == "text":
            return F.col(covered).alias(c)
        if c == "n_chars":
            return F.when(F.size("spans") > 0, F.length(covered)).otherwise(F.col(c)).cast(found.schema[c].dataType).alias(c)
        return F.col(f"`{c}`")

    return out.select(*[value(c) for c in columns])
