"""The registered queries of this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, jaccard_join, lexical_search, mixing, quality_classifier, quality_rules, sharding, spelling, suffix_dedup, token_output, url_filters, warc
from tidemark.llm.common import table, work_dir


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    slim = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharding.shard(slim, n_shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{work_dir(spark)}/warc"
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{work_dir(spark)}/tokens"
    token_output.write(table(spark, sf_dir, "documents"), path)
    return token_output.digests(spark, path)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), delete_one_in=199, least_length=6, least_n=5, times=5)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_decontaminate": op2_decontaminate,
    "op3_mixing": op3_mixing,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_url_filters": op5_url_filters,
    "op6_sharding": op6_sharding,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_warc": op9_warc,
    "op10_token_output": op10_token_output,
    "op11_lexical_search": op11_lexical_search,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_bpe": op13_bpe,
}

ORACLES: dict[str, str] = {
    "op3_mixing": r"""
with recursive docs as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
sizes as (select source, sum(size)::bigint as source_size from docs group by source),
named as (select source, source_size, row_number() over (order by source nulls last) as place from sizes),
weighted as (select *, [5.0, 2.0, 1.0][((place - 1) % 3 + 1)::int]::double as weight, source_size * 2.0::double as cap from named),
filled as (select *, cap / weight as ratio, (sum(source_size) over ())::double * 1.5::double as words,
    coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0) as capped,
    sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0) as free from weighted),
levels as (select *, case when (words - capped) / free <= ratio then (words - capped) / free end as open from filled),
targets as (select source, source_size, round(least(cap, coalesce(max(open) over () * weight, cap)), 6) as target from levels),
placed as (select d.doc_id, d.source, d.size, t.source_size, t.target,
    row_number() over (partition by d.source order by d.size, d.doc_id) - 1 as place,
    case when t.source_size > 0 then t.target / t.source_size else 0 end as rate,
    ('0x' || substr(md5('17:' || coalesce(d.source, '')), 1, 8))::bigint::double / 4294967296.0::double as off
  from docs d join targets t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (size * (floor(off + rate * (place + 1)) - floor(off + rate * place)))::bigint as taken from placed
""",
    "op5_url_filters": r"""
with rest as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
split as (select page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path, coalesce(regexp_replace(rest, '^[^/?#]*', ''), '') as after from rest),
ruled as (select *, case
    when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from split)
select page_id, host, path, rule, case
    when rule in ('net/', 'example.com/de/') then 'block'
    when rule in ('example.net/en/', 'org/fr/') then 'allow'
    when regexp_matches(host || after, '(^([^/?#]*\.)?(%s|adserver)\.|[?&]phpsessid=|/login\?|/cart/add\?)') then 'block'
    else 'allow' end as verdict from ruled
"""
    % "|".join(f"({'|'.join(first.split())})-({'|'.join(second.split())})" for first, second in url_filters.JUNK_HOSTS.values()),
    "op11_lexical_search": r"""
with asked as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
items as (select item_id, term, count(*)::bigint as times from asked group by all),
words as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
counted as (select doc_id, term, count(*)::bigint as tf from words group by all),
lengths as (select doc_id, sum(tf)::bigint as n from counted group by doc_id),
corpus as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from lengths),
weights as (select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from counted, corpus group by term),
placed as (select doc_id, 75 + ((25 * n * n_docs) // n_terms) as m from lengths, corpus),
scores as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
  from items join counted using (term) join weights using (term) join placed using (doc_id) group by item_id, doc_id),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from scores where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 20
""",
}
