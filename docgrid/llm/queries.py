"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.llm.common import crc_mod, cut, documents


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgrid.llm.pii import find_personal_data

    found = find_personal_data(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_url", "n_account")


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgrid.llm.decontam import contamination

    docs = documents(spark, sf_dir)
    hits = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("id")
    every = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row")).join(hits, "row", "left")
    return every.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce(F.size("item_ids"), F.lit(0)).alias("n_items"), "item_ids", "distances", "spans")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgrid.llm.exact_dedup import exact_groups

    groups = exact_groups(documents(spark, sf_dir))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("id") == F.col("keep_id")).alias("kept"), "text_sha256")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgrid.llm.quality import score_documents, train

    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_mod("doc_id", 3) != 1)
    scored = score_documents(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgrid.llm.ngram_join import jaccard_components

    return jaccard_components(documents(spark, sf_dir), k=4, percent=85).withColumnRenamed("id", "doc_id")


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgrid.llm.shard import shard_rows

    text = F.coalesce("text", F.lit(""))
    slim = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shard_rows(slim, ["doc_id", "text_crc32", "size"], 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Fixed by the contract: verdict, host, path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgrid.llm.url_filter import filter_urls, html_edges

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    edges, _ = cut(html_edges(pages), "edges")
    return filter_urls(pages, RULES, edges).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgrid.llm.suffix_dedup import remove_repeats

    return remove_repeats(documents(spark, sf_dir), length=200).withColumnRenamed("id", "doc_id")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from docgrid.llm.bpe import encode_documents

    out = encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.withColumnRenamed("id", "doc_id")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgrid.llm.lm import score_documents, train

    docs = documents(spark, sf_dir).select("doc_id", "text")
    model, counts, _ = train(docs.where(crc_mod("doc_id", 10) != 0))
    scored = score_documents(docs, model, counts).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", (crc_mod("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op11_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from docgrid.llm.pack import pack_documents

    out = pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgrid.llm.hard_negatives import mine

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), x.cast("double")).otherwise(F.floor(x.cast("double") * 256).cast("double")))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), label.alias("label"), vector.alias("vector"), (F.col("vec_id") % 100 == 0).alias("anchor"))
    return mine(rows)


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgrid.llm.conversation import audit_conversations, damage, replay

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return replay(*audit_conversations(damage(rows), rows), digest=True).withColumnRenamed("conv", "conv_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_decontam, op3_exact_dedup, op4_quality, op5_ngram_join, op6_shard, op7_url_filter, op8_suffix_dedup, op9_bpe, op10_lm, op11_pack, op12_hard_negatives, op13_conversations)}


def oracle_sql() -> dict[str, str]:
    from docgrid.llm.sql import SQL

    return {k: v for k, v in SQL.items() if k in queries()}
