"""The thin queries: each operator on its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contigua.llm import audio, bpe, exact_dedup, minhash, packing, pii, secrets, substring_dedup, toxicity, warc
from contigua.session import table


def op1_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_prefix_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), path or public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op4_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"), full=False)


def op5_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"), full=False)


def op6_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents")).drop("found")


def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.features(audio.store(table(spark, sf_dir, "documents")))


def op10_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_length_buckets, op2_dart_minhash, op3_prefix_bpe, op4_weak_pii, op5_window_dedup, op6_radix_dedup, op7_trigram_secrets, op8_arc_to_warc, op9_audio_features, op10_channel_toxicity)}


def _span_sql(kinds: list[str], rules: dict) -> str:
    """Spans of each rule from the matches and what lies between them."""
    parts = []
    for k, name in enumerate(kinds):
        expression, group, least = rules[name]
        expression = expression.replace("'", "''")
        own = f"regexp_extract(m, '{expression}', {group})" if group else "m"
        parts.append(
            f"select id, {k} as kind, '{name}' as name, a as s, a + length(m) as e from (select id, m, own, sum(length(g) + length(m)) over (partition by id order by i) - length(m) as a from "
            f"(select id, i, ms[i] as m, gs[i] as g, {own.replace('(m,', '(ms[i],') if group else 'ms[i]'} as own from (select id, ms, gs, unnest(range(1, len(ms) + 1)) as i from "
            f"(select id, regexp_extract_all(text, '{expression}') as ms, regexp_split_to_array(text, '{expression}') as gs from d)))) where length(own) >= {least}"
        )
    return " union all ".join(parts)


def oracle_sql() -> dict[str, str]:
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    rules = secrets.BASE_RULES | secrets.ADDED_RULES
    kinds = list(rules)
    word = r"[^\x20\x09-\x0D]+"
    out = {}
    out["op5_window_dedup"] = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{word}') as w from documents),
win as (select doc_id, unnest(range(1, len(w) - 18)) as s, w from d where len(w) >= 20),
keyed as (select doc_id, s, array_to_string(w[s:s + 19], ' ') as k from win),
rep as (select doc_id, s from (select doc_id, s, row_number() over (partition by k order by doc_id, s) as n from keyed) where n > 1),
gone as (select distinct doc_id, unnest(range(s, s + 20)) as p from rep),
words as (select doc_id, p, w[p] as x from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d)),
kept as (select words.doc_id, count(*) as n, string_agg(x, ' ' order by p) as t from words anti join gone using (doc_id, p) group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)"""
    out["op6_radix_dedup"] = f"""
with d as (select doc_id, length(coalesce(text, '')) as points, translate(coalesce(text, ''), {space}, '') as t from documents)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from
(select doc_id, t, first_value(doc_id) over (partition by t order by points desc, doc_id) as keep_id, count(*) over (partition by t) as group_size from d)"""
    out["op7_trigram_secrets"] = f"""
with d as (select doc_id as id, coalesce(text, '') as text from documents),
f as materialized ({_span_sql(kinds, rules)}),
g as (select id, count(*) filter (kind = 0) as a, count(*) filter (kind = 1) as b, count(*) filter (kind = 2) as c,
  string_agg(name || ':' || s || ':' || e, ',' order by s, kind) filter (kind < 3) as base, string_agg(name || ':' || s || ':' || e, ',' order by s, kind) as spans from f group by id)
select d.id as doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (id)"""
    out["op8_arc_to_warc"] = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, h, sha1(h) as x from p),
b as (select page_id, h, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(x, (i // 4) * 5 + 1, 5) as bigint) >> (15 - 5 * (i % 4))) & 31), 1) for i in range(32)], '') as payload_digest,
  min(page_id) over (partition by h) as f from d)
select page_id, cast(strlen(h) as bigint) as payload_bytes, payload_digest, case when page_id = f then 'response' else 'revisit' end as record_type, case when page_id <> f then f end as refers_to from b"""
    return out
