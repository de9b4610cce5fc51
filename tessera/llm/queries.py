"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, langid, lexical, licenses, line_dedup, lm, merkle, mixing, quality, simhash, token_counts, topk, warc
from tessera.llm.common import read_table

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(fn):
    Q[fn.__name__] = fn
    return fn


@register
def op3_token_counts(spark, sf):
    return token_counts.token_counts(read_table(spark, sf, "documents"))


@register
def op4_byte_bpe(spark, sf):
    return bpe.round_trip(read_table(spark, sf, "documents"))


@register
def op10_simhash(spark, sf):
    return simhash.near_duplicates(read_table(spark, sf, "documents"))


@register
def op9_quality(spark, sf):
    return quality.quality(read_table(spark, sf, "documents").select("doc_id", "text", "lang"))


@register
def op7_lm_scoring(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    held = docs.withColumn("held_out", lm.held_out(F.col("doc_id"))).withColumn("train", ~F.col("held_out"))
    return lm.score(held, keep=("doc_id", "held_out"))


SQL["op9_quality"] = quality.SQL


@register
def op8_top_k(spark, sf):
    return topk.search(read_table(spark, sf, "embeddings"))


SQL["op8_top_k"] = topk.SQL


@register
def op6_line_dedup(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "text", F.col("_n_lines").alias("n_lines"),
                                               F.col("_n_removed").alias("n_removed"))


SQL["op6_line_dedup"] = line_dedup.SQL


@register
def op2_warc(spark, sf):
    return warc.archive_round_trip(read_table(spark, sf, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op2_warc"] = warc.SQL


@register
def op5_langid(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", langid.held_out(F.col("doc_id"))).withColumn("train", ~F.col("held_out"))
    return langid.identify(docs, langid.learn(docs), keep=("doc_id", "held_out"))


@register
def op1_mixing(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text", "source", "lang")
    return mixing.mixed_documents(docs).select(
        "doc_id", "source", "lang", "topic", F.col("_tokens").alias("n_tokens"), F.round("_weight", 6).alias("weight"),
        F.round("_prob", 6).alias("prob"), F.col("_sampled").alias("sampled"))


SQL["op1_mixing"] = mixing.SQL


@register
def op11_lexical_search(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    found = lexical.search(docs, read_table(spark, sf, "benchmark"))
    return found.withColumnRenamed("query_id", "item_id")


SQL["op11_lexical_search"] = lexical.SQL


@register
def op12_merkle(spark, sf):
    docs = read_table(spark, sf, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle.proofs(merkle.manifest(docs, changed={"n_chars": F.col("n_chars") + 1}, where=tampered))


SQL["op12_merkle"] = merkle.SQL


@register
def op13_licenses(spark, sf):
    return licenses.digest(licenses.scan(read_table(spark, sf, "documents").select("doc_id", "text")))
