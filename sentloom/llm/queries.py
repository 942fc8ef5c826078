"""The registered queries of this subpackage, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentloom.llm import bursttrie, chat, decontam, langid, linededup, negatives, packing, pii, quality, sharding, simhash, urls, warc
from sentloom.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.with_references(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    manifest = warc.write_warc(records, warc.archive_folder(spark))
    found = warc.read_warc(manifest, payloads=False)
    return found.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )


URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = urls.build_index(spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))
    return urls.judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), index)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents", "doc_id", "text"))

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind))

    def joined(spans: str):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    return found.select(
        "doc_id",
        *[number(kind).cast("bigint").alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.collect_turns(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    found = chat.format_preferences(chat.answer_pairs(turns))

    def joined(spans: str):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    return found.select(
        "conv_id", F.col("prompt_turns").cast("bigint").alias("prompt_turns"), "prompt", "chosen", "rejected",
        joined("chosen_spans").alias("chosen_mask"), joined("rejected_spans").alias("rejected_mask"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.document_shards(table(spark, sf_dir, "documents", "doc_id", "text", "source"), 8)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        *[m for m in quality.MEASURES if m != "n_lines"],
        (~quality.passes("base")).alias("base_failed"),
        quality.passes("2").alias("kept"),
        "n_lines",
        "failed",
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.drop_frequent_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bursttrie.prefix_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.quantised(vectors.withColumn("label", moved))
    return negatives.hard_negatives(rows, rows.filter(F.col("id") % 100 == 0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_decontamination": op2_decontamination,
    "op3_warc": op3_warc,
    "op4_urls": op4_urls,
    "op5_personal_data": op5_personal_data,
    "op6_simhash": op6_simhash,
    "op7_chat": op7_chat,
    "op8_sharding": op8_sharding,
    "op9_quality": op9_quality,
    "op10_language": op10_language,
    "op11_line_dedup": op11_line_dedup,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_hard_negatives": op13_hard_negatives,
}
