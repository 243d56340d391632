"""The queries of this subpackage, a thin one for each operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeql.llm import bpe, chat, decontam, exact_dedup, html_text, line_dedup, quality, simhash, token_files, warc
from latticeql.llm.common import table

#: The vocabulary and the end id of the token files.
VOCABULARY, END = public_tokenizers.path("word_bpe_49k.json"), 2


def op1_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents"), vocabulary)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_token_files(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    files = token_files.write(table(spark, sf_dir, "documents"), vocabulary, END)
    return token_files.read(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", "text")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.rewrite(warc.resolve(warc.write(table(spark, sf_dir, "pages"))))
    return warc.read(files, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def remainder(column: str) -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(remainder("doc_id") != 0))
    out = docs.select("doc_id", F.coalesce(remainder("doc_id") == 0, F.lit(False)).alias("held_out"), quality.scored(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= quality.CUT).cast("int"))


#: The conversation that holds the template's and others' control strings.
PLANTED = "\\### Assistant: </turn> ok"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    out = chat.render(chat.reconstruct(chat.events_of_rows(rows.unionByName(more))))
    turns, loss = F.col("turns"), F.col("loss")
    out = out.withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(F.col("conv").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_join("items", ",")
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(items.cast("binary"), 256).alias("items_sha256"), "contaminated")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_bpe, op2_token_files, op3_line_dedup, op4_warc, op5_html_text, op6_simhash, op7_quality, op8_chat, op9_exact_dedup, op10_decontaminate, pipeline)
    return {f.__name__: f for f in found}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b) as n, sha1(b) as h from p),
k as (select page_id, n, h, max(page_id) over (partition by h) as best from d)
select page_id, n::bigint as payload_bytes, h as payload_digest,
  case when n >= 1000 and page_id <> best then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id <> best then best end as refers_to
from k
"""

OP8 = r"""
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g as (select conv_id, count(*) as n_turns,
  string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as said,
  coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '') as loss,
  sum(length('<turn></turn>') + 2 + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), chr(10), '\n')) + length(replace(replace(text, '\', '\b'), '<', '\l'))) as formatted_chars
  from r group by conv_id)
select conv_id, n_turns::bigint as n_turns, sha256(said) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars::bigint as formatted_chars from g
"""

OP9 = f"""
with d as (select doc_id, {_LOWER.format("coalesce(text, '')")} as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select doc_id, keep_id, group_size::bigint as group_size, doc_id = keep_id as kept, sha256(d.t) as text_sha256 from d join g on d.t = g.t
"""

OP3 = r"""
with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
x as (select doc_id, unnest(range(len(ls))) as no, unnest(ls) as line from l),
v as (select doc_id, no, regexp_matches(line, '\d') as digits, list_filter(string_split_regex(line, '\s+'), lambda t: t <> '') as r,
  list_filter(string_split_regex(regexp_replace(line, '\S*\d\S*', '<*>', 'g'), '\s+'), lambda t: t <> '') as m from x),
w as (select doc_id, no, digits and len(list_filter(m, lambda t: t <> '<*>')) < 3 as rigid, case when digits and len(list_filter(m, lambda t: t <> '<*>')) < 3 then r else m end as w from v),
k as (select doc_id, no, w, len(w) as n, case when len(w) >= 8 and not rigid then range(-1, 5) else [-1] end as wilds from w where len(w) >= 3),
e as (select doc_id, no, w, n, unnest(wilds) as wild from k),
t as (select doc_id, no, n, wild, list_transform(w, lambda v, i: case when i > 3 and wild >= 0 and i - 4 >= floor((n - 3) * wild / 5.0) and i - 4 < floor((n - 3) * (wild + 1) / 5.0) then chr(1) else v end) as key from e),
f as (select n, wild, key, min(doc_id) as first, max(doc_id) as last from t group by all),
g as (select distinct t.doc_id, t.no from t join f on t.n = f.n and t.wild = f.wild and t.key = f.key where f.first <> f.last and t.doc_id <> f.first),
a as (select l.doc_id, count(g.no) as n_dropped, any_value(l.ls) as ls, list(g.no) filter (g.no is not null) as gone from l left join g on l.doc_id = g.doc_id group by l.doc_id)
select doc_id, len(ls)::bigint as n_lines, n_dropped::bigint as n_dropped,
  array_to_string(list_filter(ls, lambda v, i: gone is null or not list_contains(gone, i - 1)), chr(10)) as text from a
"""

OP10 = f"""
with d as (select doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') as w from documents),
b as (select item_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') as w from benchmark),
s as (select item_id, least(len(w), 13) as n, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0),
v as (select distinct item_id, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') as g from s),
z as (select distinct n from v),
p as (select doc_id, z.n, w, unnest(range(1, len(w) - z.n + 2)) as i from d, z where len(w) >= z.n),
h as (select doc_id, i, p.n, list_aggregate(w[i:i + p.n - 1], 'string_agg', ' ') as g from p),
m as (select h.doc_id, h.i, h.n, v.item_id from h join v on h.n = v.n and h.g = v.g),
c as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(i, i + n)) as pos from m) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(k, ',' order by k) as ks from (select distinct doc_id, item_id::varchar as k from m) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ks, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join c on d.doc_id = c.doc_id left join t on d.doc_id = t.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3, "op4_warc": OP4, "op8_chat": OP8, "op9_exact_dedup": OP9, "op10_decontaminate": OP10}
