"""The queries op1 to op13 over the synthetic tables, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kymo.llm import bpe, exact_dedup, fill_in_middle, html_text, mixing, pieces, shuffle, simhash, suffix_dedup, topk, toxicity, warc, whitening
from kymo.llm.common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents encoded and decoded."""
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op2_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to 40 shards by a uniform shuffle; law: rows.

    A row is dealt by its place, not by its text, so equal texts spread over the shards as any rows do.
    """
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(data) + 16).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    dealt = shuffle.shuffle_shards(docs, 40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents takes of each."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best vectors for each whose id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents and the one of each that stays."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=~toxicity.is_held_out())
    return toxicity.score(docs, model).select("doc_id", toxicity.is_held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated passages."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, with weights learned from labelled pages."""
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.learn_weights(pages))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents encoded and decoded by a SentencePiece model, with ids of begin and end."""
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings centred, projected on 32 principal components and scaled to unit variance."""
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents cut in three and reordered, and put together again."""
    cut = fill_in_middle.transform(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_in_middle.restored(), 256).alias("restored_sha256"))


def queries() -> dict:
    found = (op1_bpe, op2_shuffle, op3_mixing, op4_topk, op5_simhash, op6_warc, op7_exact_dedup, op8_toxicity, op9_suffix_dedup, op10_html, op11_pieces, op12_whitening, op13_fill_in_middle)
    return {f.__name__: f for f in found}


_OP3 = r"""
with sized as (
  select doc_id, source, source is null as is_null, coalesce(source, '') as name,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5(concat_ws(':', doc_id::varchar, 'mix-1', md5(text))) as draw
  from documents),
sources as (select is_null, name, sum(size)::bigint as source_size from sized group by all),
ranked as (select *, row_number() over (order by is_null, encode(name)) - 1 as src from sources),
weighted as (select *, case src % 3 when 0 then 3 when 1 then 1 else 2 end as weight, 2 * source_size as cap from ranked),
running as (
  select *, sum(cap) over (order by cap / weight, src rows between unbounded preceding and current row) - cap as caps_before,
    sum(weight) over (order by cap / weight, src rows between current row and unbounded following) as weight_left,
    1.5::double * sum(source_size) over () as total from weighted),
levels as (
  select *, max(case when (total - caps_before) * weight <= cap * weight_left::double then (total - caps_before) / weight_left end) over () as level from running),
goals as (
  select is_null, name, source_size, least(cap::double, coalesce(level, 'infinity'::double) * weight) as target from levels),
planned as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as whole from goals),
drawn as (
  select s.*, p.source_size, p.target, p.whole, round(p.target)::bigint - p.whole * p.source_size
    - (sum(s.size) over (partition by s.is_null, s.name order by s.draw, s.doc_id nulls last, s.size rows between unbounded preceding and current row) - s.size) as budget
  from sized s join planned p using (is_null, name))
select doc_id, size, source_size, target, (whole * size + greatest(0, least(size, budget)))::bigint as taken from drawn"""

_OP4 = """
with plain as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from plain q join plain c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from scored)
select query_id, r::integer as rank, vec_id, score from ranked where r <= 5"""

_OP6 = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha256(html) as payload_digest, min(page_id) over (partition by html) as first from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first then first end as refers_to from d"""

_OP7 = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as content from documents),
g as (
  select doc_id, content, first_value(doc_id) over (partition by content order by n_chars desc, doc_id rows between unbounded preceding and unbounded following) as keep_id,
    count(*) over (partition by content) as group_size from d)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(content) as text_sha256 from g"""

_OP9 = """
with docs as (select doc_id, encode(coalesce(text, '')) as b, hex(encode(coalesce(text, ''))) as x from documents),
starts as (select doc_id, x, unnest(range(octet_length(b) - 199)) as i from docs where octet_length(b) >= 200),
keyed as (select doc_id, i, md5_number(substr(x, 2 * i + 1, 400)) as w from starts),
hit as (select doc_id, i from (select *, count(*) over (partition by w) as n from keyed) where n > 1),
ordered as (select *, i > 200 + lag(i) over (partition by doc_id order by i) as cut from hit),
spans as (
  select doc_id, min(i) as a, max(i) + 200 as b from (
    select *, sum(coalesce(cut, true)::int) over (partition by doc_id order by i) as s from ordered) group by doc_id, s),
edges as (
  select doc_id, x, octet_length(d.b) as n, s.a, s.b, coalesce(lag(s.b) over (partition by doc_id order by s.a), 0) as before,
    row_number() over (partition by doc_id order by s.a desc) as last from docs d left join spans s using (doc_id)),
parts as (
  select doc_id, n, a, b, case when a is null then x
    else substr(x, 2 * before + 1, 2 * (a - before)) || case when last = 1 then substr(x, 2 * b + 1) else '' end end as kept from edges)
select doc_id, max(n)::bigint as n_bytes, coalesce(sum(b - a), 0)::bigint as n_removed, count(a)::bigint as n_spans,
  sha256(unhex(string_agg(kept, '' order by a))) as kept_sha256 from parts group by doc_id"""

_OP13 = """
with d as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as tokens,
    sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
drawn as (
  select *, len(tokens)::bigint as n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::bigint) as x from d),
formed as (
  select *, least(x[1] % (n + 1), x[2] % (n + 1)) as a, greatest(x[1] % (n + 1), x[2] % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or x[3] % 100 >= 90 then 'plain'
      when x[4] % 100 < 20 then 'spm' else 'psm' end as form from drawn),
cut as (
  select doc_id, n, form, text, array_to_string(tokens[1:a], '') as p, array_to_string(tokens[a + 1:b], '') as m, array_to_string(tokens[b + 1:n], '') as s from formed)
select doc_id, n, form, case when form <> 'plain' then length(p)::bigint end as prefix_chars, case when form <> 'plain' then length(m)::bigint end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256 from cut"""


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": _OP3, "op4_topk": _OP4, "op6_warc": _OP6, "op7_exact_dedup": _OP7, "op9_suffix_dedup": _OP9, "op13_fill_in_middle": _OP13}
