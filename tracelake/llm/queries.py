"""The registered queries: each applies one operator to its whole table with production
parameters and returns the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import ann, chat, decontaminate, html_text, jaccard, known_licences, langid, licences, packing, quality, secrets
from tracelake.llm.common import id_crc, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(id_crc("doc_id") % 3 == 1, F.lit(False))
    profiles = langid.fit_profiles(docs.where(~held_out & F.col("doc_id").isNotNull()))
    return langid.identify(docs.select("doc_id", "text"), profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, secrets.fit_crf(docs))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    told = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("secrets")).alias("spans"), count("crf"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(id_crc("doc_id") % 4 == 2, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out)
    model = quality.fit_quality(docs, labels)
    return quality.score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda vec_id: vec_id % 100 == 0)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations hold no tool calls, so each message is looked up, or found, by a tool."""
    schemas = spark.createDataFrame([*chat.LOOKUP], chat.SCHEMA)
    return chat.link_tools(chat.with_lookups(table(spark, sf_dir, "conversations")), schemas)


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), known_licences.table(spark))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, percent=90)


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_decontamination": op2_decontamination,
    "op3_packing": op3_packing,
    "op4_secrets": op4_secrets,
    "op5_html_text": op5_html_text,
    "op6_quality": op6_quality,
    "op7_nearest": op7_nearest,
    "op8_chat": op8_chat,
    "op9_licences": op9_licences,
    "op10_jaccard": op10_jaccard,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CONTAMINATION_SQL = rf"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
windows as (select distinct item, least(len(w), 10) as n, w[i : i + least(len(w), 10) - 1] as win from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct n from windows),
places as (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n),
hits as (select rid, i, p.n as n, item from (select rid, n, i, w[i : i + n - 1] as win from places) p join windows using (n, win)),
items as (select rid, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as told from hits group by rid),
covered as (select rid, count(distinct place) as n_hit from (select rid, unnest(range(i, i + n)) as place from hits) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(told, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join items using (rid) left join covered using (rid)
"""

JACCARD_SQL = rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, w[i : i + least(len(w), 3) - 1] as gram from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from d where len(w) > 0)),
sizes as (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as u, b.doc_id as v, count(*) as c from s a join s b using (gram) where a.doc_id < b.doc_id group by 1, 2),
links as (select u, v from common join sizes x on u = x.doc_id join sizes y on v = y.doc_id where 100 * c >= 90 * (x.n + y.n - c)),
reach(u, v) as (select u, v from links union select v, u from links union select r.u, l.v from reach r join (select u, v from links union all select v, u from links) l on r.v = l.u)
select doc_id, coalesce(n, 0) as n_shingles, least(doc_id, coalesce(m, doc_id)) as component_id
from documents left join sizes using (doc_id) left join (select u as doc_id, min(v) as m from reach group by u) using (doc_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": CONTAMINATION_SQL,
    "op10_jaccard": JACCARD_SQL,
    "op8_chat": chat.LOOKUP_SQL,
    "op9_licences": licences.scan_sql(known_licences.rows()),
}
