"""Queries of the training-data operators over the given tables, with oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flockwatch.llm.bpe import decode, encode
from flockwatch.llm.chunkdedup import remove_chunks
from flockwatch.llm.common import read_table
from flockwatch.llm.convrepair import damage, digests, repair
from flockwatch.llm.decontaminate import contamination
from flockwatch.llm.hardneg import hard_negatives, quantised
from flockwatch.llm.jaccard import linked_components
from flockwatch.llm.linededup import dedup_lines
from flockwatch.llm.mixing import mix_by_source
from flockwatch.llm.neardup import near_duplicates
from flockwatch.llm.sharding import shard_documents
from flockwatch.llm.suffixdedup import digest as repeat_digest
from flockwatch.llm.suffixdedup import remove_repeats
from flockwatch.llm.tokencount import recount
from flockwatch.llm.toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


@register("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole text of documents, learned outside the held-out fifth."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted")


SQL_OP2 = r"""
with l as (select rid, doc_id, i, xs[i] as line,
                  translate(trim(xs[i], e' \t\n\x0b\x0c\r'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
           from (select rid, doc_id, xs, unnest(range(1, len(xs) + 1)) as i
                 from (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as xs
                       from documents))),
o as (select k, min(doc_id) as owner from l where length(k) >= 10 group by k having count(distinct doc_id) > 1),
m as (select l.*, owner is not null and doc_id <> owner as gone from l left join o using (k))
select doc_id, count(*) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from m group by rid, doc_id
"""


@register("op2_line_dedup", SQL_OP2)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every whole document that an earlier document holds too, dropped."""
    out = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@register("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every whole document covered by a 200-byte string that also starts elsewhere, removed."""
    out = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", *repeat_digest(), "kept_sha256")


@register("op4_sharding")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 40 shards of near equal bytes; equal texts stay together."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_documents(docs, 40).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@register("op8_embedding_dedup")
def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all embeddings under cosine links of 0.95 and more."""
    return near_duplicates(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@register("op9_substring_dedup")
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of content-defined chunks of every whole document that stand elsewhere first, removed."""
    out = remove_chunks(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_chunks", "n_repeated", *repeat_digest(), "kept_sha256")


@register("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole document before and after its mail addresses and long numbers are masked."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return recount(docs).select("doc_id", "tokens_before", "n_edits", "tokens_after", "n_encoded")


SQL_OP6 = r"""
with w as (select doc_id, row_number() over () as rid,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
           from documents),
i as (select distinct item_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
      from benchmark),
iw as (select distinct item_id, len(ws[s : s + least(13, len(ws)) - 1]) as k,
              array_to_string(ws[s : s + least(13, len(ws)) - 1], ' ') as g
       from (select item_id, ws, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) as s from i where len(ws) > 0)),
ks as (select distinct k from iw),
dw as (select rid, k, s, array_to_string(ws[s : s + k - 1], ' ') as g
       from (select rid, ws, k, unnest(range(1, len(ws) - k + 2)) as s from w, ks where len(ws) >= k)),
m as (select rid, k, s, item_id from dw join iw using (k, g)),
hit as (select rid, count(distinct p) as n_hit
        from (select rid, unnest(range(s, s + k)) as p from (select distinct rid, k, s from m)) group by rid),
its as (select rid, count(distinct cast(item_id as varchar)) as n_items,
               string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids
        from m group by rid)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from w left join hit using (rid) left join its using (rid)
"""


@register("op6_decontamination", SQL_OP6)
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every whole document, and the contamination rule."""
    out = contamination(read_table(spark, sf_dir, "documents").select("doc_id", "text"),
                        read_table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@register("op7_jaccard")
def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under exact five-word Jaccard links of 0.8 and more."""
    out = linked_components(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id")


@register("op10_mixing")
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights of their sources."""
    return mix_by_source(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


@register("op11_conversation_repair")
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by rule and repaired at the least cost."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = repair(damage(turns))
    out = turns.select("conv_id").distinct()
    for part in (fixed.summary, digests(fixed.rows)):
        part = part.withColumnRenamed("conv_id", "_c")
        out = out.join(part, out["conv_id"].eqNullSafe(part["_c"]), "left").drop("_c")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in counts],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


SQL_OP12 = """
with r as (select distinct vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                  list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
           from embeddings
           where vec_id is not null and label is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.id as anchor_id, b.id as id, a.label = b.label as same,
             cast(list_inner_product(a.q, b.q) as bigint) as score
      from r a join r b on a.id % 100 = 0 and a.id <> b.id),
p as (select anchor_id, id as positive_id, score as positive_score from s where same
      qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id,
       cast(row_number() over (partition by anchor_id, positive_id order by score desc, id) as integer) as rank,
       id as negative_id, positive_score, score as negative_score
from p join (select * from s where not same) using (anchor_id)
where 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, id) <= 5
"""


@register("op12_hard_negatives", SQL_OP12)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding against all embeddings."""
    rows = quantised(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), "q",
                                      (F.col("vec_id") % 100 == 0).alias("is_anchor")))


@register("op13_byte_bpe")
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded by the public byte-level vocabulary and decoded again."""
    import public_tokenizers
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decode(ids, ranks).select("doc_id", "n_tokens", F.sha2(text.cast("binary"), 256).alias("ids_sha256"),
                                     F.sha2("decoded", 256).alias("decoded_sha256"))
