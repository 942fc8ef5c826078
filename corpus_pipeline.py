"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``. :func:`run` writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentloom.llm import decontam, packing, pii, quality, simhash
from sentloom.llm.common import free_name, table
from sentloom.session import materialize


def _as(docs: DataFrame, df: DataFrame) -> DataFrame:
    return df.select(*docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no quality rule. Rows of one id are judged by their own measurements:
    the verdict joins on id and text."""
    return quality.keep_passing(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash near-duplicates (3-word shingles, at most 2 bits apart) the row with
    the smallest id stays; rows of one id are judged by their own texts."""
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    hit = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = hit.select(F.col("doc_id").alias("_kept_id"), F.col("text_key").alias("_kept_key"))
    same = F.col("doc_id").eqNullSafe(F.col("_kept_id")) & F.xxhash64("text").eqNullSafe(F.col("_kept_key"))
    return _as(docs, docs.join(hit, same, "left_anti"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span becomes its kind in brackets; ``n_chars`` is the new length where it changed."""
    base, spans, changed = (free_name(docs, c) for c in ("base", "spans", "changed"))
    found = pii.find_personal_data(docs, base_col=base, spans_col=spans)
    redacted = pii.redact(
        found.withColumn(changed, F.size(spans) > 0), base_col=base, spans_col=spans
    )
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return _as(
        docs,
        redacted.withColumn("n_chars", F.when(F.col(changed), length).otherwise(F.col("n_chars"))),
    )


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens, with their ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("personal data", redact_personal_data),
    ("packing", pack),
]

#: SQL can not state the components, the random field or the packing; the tests compare the
#: stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
