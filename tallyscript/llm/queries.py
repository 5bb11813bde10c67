"""The query of each operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, jaccard, neardup, packing, permutation, pii, quality, toxicity, warc
from .tables import table


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.search(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]
    rows = rows.unionByName(spark.createDataFrame(own, "conv_id long, turn long, role string, text string"))
    return chat.read_back(chat.format_turns(rows.withColumn("parts", chat.text_part(F.col("text")))))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


QUERIES = (
    op1_permutation_index,
    op2_warc_archive,
    op3_best_fit_packing,
    op4_toxicity,
    op5_byte_bpe,
    op6_chat_format,
    op7_quality,
    op8_embedding_near_dedup,
    op9_jaccard_join,
    op10_pii,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


_WARC = """with p as (select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as d from pages),
 f as (select d, min(page_id) as least from p where n >= 100 group by d)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest, case when n >= 100 and page_id <> least then 'revisit' else 'response' end as record_type,
 case when n >= 100 and page_id <> least then least end as refers_to from p left join f using (d)"""

#: An escaped text is longer by one for each control string in it.
_CHAT = r"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
 f as (select *, length(text) + len(regexp_extract_all(text, '[<\[]\\*(?:\||/?s>|<SYS>|</SYS>|/?INST\])')) + length(role) + 16 as chars, case when role = 'assistant' then text else '' end as loss from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256, cast(sum(length(loss)) as bigint) as loss_chars,
 sha256(string_agg(loss, '' order by turn nulls first, role, text)) as loss_sha256, cast(sum(chars) as bigint) as formatted_chars from f group by conv_id"""

_NEAR = """with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings),
 good as (select * from v where label is not null and len(e) > 0 and not list_contains(list_transform(e, lambda x: x is null or not isfinite(x)), true) and list_contains(list_transform(e, lambda x: x <> 0), true)),
 links as materialized (select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and a.vec_id <> b.vec_id where len(a.e) = len(b.e) and list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
 reach as (select vec_id, vec_id as c from v union select l.b, r.c from reach r join links l on l.a = r.vec_id),
 least as (select vec_id, min(c) as component_id from reach group by vec_id)
select vec_id, (select count(*) from links where a = vec_id) as n_links, component_id, vec_id = component_id as kept from least"""

_JACCARD = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') as w from documents),
 s as (select doc_id, case when len(w) = 0 then [] else list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) end as s from w),
 x as (select doc_id, len(s) as n, unnest(s) as g from s),
 links as materialized (select a, b from (select x.doc_id as a, y.doc_id as b, x.n as na, y.n as nb, count(*) as k from x join x y on x.g = y.g and x.doc_id <> y.doc_id group by all) where 100 * k >= 90 * (na + nb - k)),
 reach as (select doc_id, doc_id as c from s union select l.b, r.c from reach r join links l on l.a = r.doc_id),
 least as (select doc_id, min(c) as component_id from reach group by doc_id)
select s.doc_id, cast(len(s) as bigint) as n_shingles, (select count(*) from links where a = s.doc_id) as n_similar, component_id from s join least on s.doc_id = least.doc_id"""


def oracle_sql() -> dict[str, str]:
    """For the queries whose rows SQL can give: not what a tokenizer, a trained model or an approximate index decides."""
    return {"op2_warc_archive": _WARC, "op6_chat_format": _CHAT, "op8_embedding_near_dedup": _NEAR, "op9_jaccard_join": _JACCARD}
