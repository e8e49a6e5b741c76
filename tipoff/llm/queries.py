"""One query for each operator, over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.llm.conversation_trie import prefix_trie
from tipoff.llm.decontaminate import find_windows, hit_report
from tipoff.llm.html_text import extract
from tipoff.llm.jaccard import Similarity, near_duplicates
from tipoff.llm.licenses import scan
from tipoff.llm.minmax import near_duplicates as min_max_duplicates
from tipoff.llm.packing import pack, piece_report
from tipoff.llm.quality import judge
from tipoff.llm.secrets import find_secrets, secret_report
from tipoff.llm.sharding import place
from tipoff.llm.token_files import id_report, read_ids, write_ids
from tipoff.llm.toxicity import CATEGORIES, fit_chain, score
from tipoff.llm.whitening import whiten
from tipoff.session import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities and decisions of the classifier chain for every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(documents, fit_chain(documents, table(spark, sf_dir, "labels"), CATEGORIES))
    return scored.select("doc_id", "p_low_quality", "p_toxic", "is_low_quality", F.col("is_toxic").alias("toxic"))


def _shingle_sql(share: int, columns: str) -> str:
    """Components of all documents over links found by joining their distinct 4-word shingles."""
    return f"""
with recursive word as materialized (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
gram as materialized (
  select distinct doc_id, array_to_string(w[k:k + least(4, len(w)) - 1], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) as k from word where len(w) > 0)),
sized as materialized (select doc_id, count(*) as n from gram group by doc_id),
copy as materialized (
  select doc_id, min(doc_id) over (partition by h, n) as class, n
  from (select doc_id, md5(string_agg(g, chr(10) order by g)) as h, count(*) as n from gram group by doc_id)),
one as materialized (select g, doc_id, n from gram join copy using (doc_id) where class = doc_id),
pair as materialized (
  select a.doc_id as a, b.doc_id as b from one a join one b on a.g = b.g and a.doc_id < b.doc_id and least(a.n, b.n) * 100 >= greatest(a.n, b.n) * {share}
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= {share} * (a.n + b.n - count(*))),
tie as materialized (select a, b from pair union all select b, a from pair),
reach(a, b) as (select distinct class, class from copy union select r.a, l.b from reach r join tie l on r.b = l.a),
least_of as (select a, min(b) as c from reach group by a),
placed as (select d.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(c, d.doc_id) as component_id
  from documents d left join copy on copy.doc_id = d.doc_id left join least_of on least_of.a = copy.class)
select doc_id, n_shingles, component_id{columns} from placed
"""


@query("op12_minmax_near_duplicates", _shingle_sql(80, ", doc_id = component_id as kept"))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by 80 % overlap of their 4-word n-grams, by min-max hashing."""
    return min_max_duplicates(table(spark, sf_dir, "documents"), Similarity(words=4, share=80))


OP11_SQL = """
with turn as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as p
  from conversations where conv_id is not null),
own as (select conv_id, list({'role': role, 'text': text} order by p) as ts from turn group by conv_id),
crc as (
  select conv_id, ts, xor(4294967295::bigint, list_reduce(
      list_prepend(4294967295::bigint, list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i::integer, 1))::bigint)),
      lambda c, x: list_reduce(list_prepend(xor(c, x), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, 3988292384::bigint * (v & 1))))) % 6 as h
  from own),
path as (
  select crc.conv_id, list_concat(coalesce(base.ts[1:h], []), crc.ts[h + 1:]) as ts
  from crc left join own base on base.conv_id = crc.conv_id - crc.conv_id % 100),
step as (select conv_id, ts[1:d] as pre, d, d = len(ts) as is_end from (select conv_id, ts, unnest(range(0, len(ts) + 1)) as d from path)),
node as (
  select pre, d, min(conv_id) as conv_id, count(*) as n, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (is_end), '')) as ends
  from step group by pre, d),
kids as (select pre[1:d - 1] as pre, count(*) as k from node where d > 0 group by 1),
known as (
  select node.pre, d, conv_id, n, ends, coalesce(k, 0) as k, case when d = 0 then 0 else (n - 1) * length(node.pre[d]['text']) end as saved
  from node left join kids on kids.pre = node.pre),
sums as (
  select up as pre, sum(case when k = 0 then 1 else 0 end) as leaves, sum(saved) as saved
  from (select pre[1:u] as up, k, saved from (select pre, k, saved, unnest(range(0, d + 1)) as u from known)) group by up)
select known.conv_id, known.d::bigint as depth, parent.conv_id as parent_conv_id, known.n::bigint as n_convs, known.k::bigint as n_children,
       leaves::bigint as n_leaves, sums.saved::bigint as saved_tokens, known.ends as ends_sha256
from known join sums on sums.pre = known.pre left join known parent on known.d > 0 and parent.pre = known.pre[1:known.d - 1]
"""


@query("op11_conversation_trie", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable embeddings on the four components of largest variance."""
    return whiten(table(spark, sf_dir, "embeddings"))


@query("op3_ngram_jaccard_join", _shingle_sql(85, ""))
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by 85 % overlap of their 4-word n-grams."""
    return near_duplicates(table(spark, sf_dir, "documents"), Similarity(words=4, share=85))


OP8_SQL = """
with doc as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
item as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from benchmark),
win as (
  select distinct item_id, least(10, len(w)) as size, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) as k from item where len(w) > 0)),
sizes as (select distinct size from win),
run as (
  select doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') as win
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as p from doc, sizes where len(w) >= size)),
hit as (select doc_id, size, p, item_id from run join win using (size, win)),
covered as (select doc_id, count(distinct word) as n_hit from (select doc_id, unnest(range(p, p + size)) as word from hit) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
          from (select distinct doc_id, item_id::varchar as item_id from hit) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join covered using (doc_id) left join named using (doc_id)
"""


@query("op8_benchmark_decontamination", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of each document lie inside a 10-word window of the benchmark."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return hit_report(find_windows(documents, table(spark, sf_dir, "benchmark").select("item_id", "text")))


@query("op10_secret_scans")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secret_report(find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids in sequences of 1024."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_report(pack(documents, public_tokenizers.path("byte_bpe_50k.json")))


@query("op1_html_extraction")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


@query("op4_quality_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; strata are languages."""
    return judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels"))


@query("op5_sharding")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document among 64 shards."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    return place(documents, ["doc_id"], [f"shard-{k:03d}" for k in range(64)])


@query("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids, written to files and read back."""
    path = new_path(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.path("word_bpe_49k.json"))
    return id_report(read_ids(spark, path))


@query("op6_license_scans")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated and inherited licence of every document.

    Paths are made from the table: source, language and hundreds of doc_id give directories of depth one to three; every twentieth
    document is its directory's licence file, if it states one.
    """
    number = F.col("doc_id").cast("string")
    folders = F.array(F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.floor(F.col("doc_id") / 100).cast("string"))
    depth = F.pmod(F.col("doc_id"), F.lit(3)).cast("int") + 1
    name = F.when(F.col("doc_id") % 20 == 0, F.concat(F.lit("LICENSE-"), number)).otherwise(F.concat(number, F.lit(".txt")))
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", F.slice(folders, 1, depth), name).alias("path"), "text")
    return scan(files, "path rlike '(^|/)LICENSE[^/]*$'", ["doc_id"])
