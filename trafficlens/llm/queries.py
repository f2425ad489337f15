"""Registered queries of the operators: each applies its operator to the whole table it is for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm import bilinear, chat, decontaminate, lexical, media, mixture, negatives, quality, secret_scan, simhash, substrings, tokens, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = toxicity.learn(documents, table(spark, sf_dir, "labels"), "toxic", ~toxicity.held_out())
    return toxicity.score(documents, weights).select("doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.written(media.store_documents(table(spark, sf_dir, "documents")))
    points = F.transform("groups", lambda g: F.struct(g["pts"], g["offset"])).alias("random_access_points")
    return media.features(media.read_media(stored)).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", points
    )


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(documents).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP5_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), windows as (
  select doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') as run from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)
), again as (
  select run from windows group by run having count(*) > 1
), gone as (
  select distinct doc_id, unnest(range(i, i + 35)) as k from windows join again using (run)
), words as (
  select doc_id, unnest(range(1, len(w) + 1)) as k, unnest(w) as word from d
), kept as (
  select doc_id, string_agg(word, ' ' order by k) as kept, count(*) as n_kept from words anti join gone using (doc_id, k) group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, len(w) - coalesce(n_kept, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join kept using (doc_id)
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = bilinear.score_all(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.summary(tokens.attribute(table(spark, sf_dir, "documents")))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(documents, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


OP9_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select coalesce(cast(item_id as varchar), 'null') as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), windows as (
  select distinct item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as run
  from (select item, w, n, unnest(range(1, len(w) - n + 2)) as i from (select item, w, least(13, len(w)) as n from b where len(w) > 0))
), places as (
  select doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as run
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from windows) where len(w) >= n)
), hits as (
  select doc_id, item, p.n, i from places p join windows v on p.n = v.n and p.run = v.run
), hit_words as (
  select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from hits) group by doc_id
), found as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item from hits) group by doc_id
)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit_words using (doc_id) left join found using (doc_id)
"""


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    turns = F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(tricky).alias("text")) for k, role in enumerate(("user", "assistant"))))
    extra = spark.range(1).select(F.explode(turns).alias("t")).select("t.*")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    shown = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chat.read_conversations(chat.format_conversations(rows)).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(shown, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP10_SQL = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked as (
  select *, lag(role) over (partition by conv_id order by turn nulls first, role, text) is distinct from role as opens,
    length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) as text_chars,
    length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&nl;')) as role_chars
  from rows
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256,
  cast(sum(text_chars + case when opens then {len(chat.TURN) + len(chat.END) + 1} + role_chars else {len(chat.PART)} end) as bigint) as formatted_chars
from marked group by conv_id
"""

def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from benchmark
), corpus as (
  select count(*) as n, cast(sum(len(t)) as bigint) as total from d where len(t) > 0
), sizes as (
  select doc_id, 100 - 25 + (25 * len(t) * n) // total as m from d, corpus where len(t) > 0
), asked as (
  select item_id, term, count(*) as times from (select item_id, unnest(t) as term from b) group by item_id, term
), postings as (
  select doc_id, term, count(*) as tf from (select doc_id, unnest(t) as term from d) where term in (select term from asked) group by doc_id, term
), weights as (
  select term, cast(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) as bigint) as w from postings, corpus group by term, n
), scores as (
  select item_id, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score
  from asked join postings using (term) join weights using (term) join sizes using (doc_id) group by item_id, doc_id
)
select item_id, cast(row_number() over best as integer) as rank, doc_id, score from scores where score > 0
window best as (partition by item_id order by score desc, doc_id) qualify row_number() over best <= 20
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


OP12_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.q, b.q) as bigint) as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from pairs where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id, cast(row_number() over best as integer) as rank, vec_id as negative_id, positive_score, score as negative_score
from positives join pairs using (anchor_id) where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
window best as (partition by anchor_id, positive_id order by score desc, vec_id) qualify row_number() over best <= 5
"""


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(documents, secret_scan.train(secret_scan.labelled_samples(documents)))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = secret_scan.listed(F.filter("spans", lambda s: s["kind"] != secret_scan.MODEL))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_media_columns": op2_media_columns,
    "op3_mix_sources": op3_mix_sources,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality": op6_quality,
    "op7_lm_score": op7_lm_score,
    "op8_token_counts": op8_token_counts,
    "op9_decontaminate": op9_decontaminate,
    "op10_chat_format": op10_chat_format,
    "op11_lexical_search": op11_lexical_search,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_secret_scan": op13_secret_scan,
}
ORACLE_SQL: dict[str, str] = {"op5_substring_dedup": OP5_SQL, "op9_decontaminate": OP9_SQL, "op10_chat_format": OP10_SQL, "op11_lexical_search": OP11_SQL, "op12_hard_negatives": OP12_SQL}
