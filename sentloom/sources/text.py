"""Text sources: sentence files, captions, pairs, labels, scored pairs, records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentloom.functions.text import clean_caption, split_sentences, ws_tokens
from sentloom.schemas import RECORDS
from sentloom.session import materialize

# Field separators, as regular expressions.
TAB = "\t"
FOUR_SPACES = " {4}"


def _patterns(patterns: str | list[str]) -> list[str]:
    parts = patterns.split(",") if isinstance(patterns, str) else patterns
    found = [p.strip() for p in parts if p.strip()]
    if not found:
        raise ValueError("no input pattern given")
    return found


def read_sentences(spark: SparkSession, patterns: str | list[str]) -> DataFrame:
    """(file, pos, text): one row per line; ``pos`` is the 0-based line number in the file.

    ``patterns`` are globs, comma-separated or a list; one that matches nothing is an error.
    Large files are read in blocks by many tasks. Line, block and row id are taken in one scan and
    stored: another scan may cut the files elsewhere. Inside a block, lines carry consecutive row
    ids; the line counts of a file's earlier blocks give the block's first line number. No line
    is sorted. A line whose block has no count is an error, not a lost row.
    """
    # lineSep is set so that only line feeds end a line.
    lines = materialize(
        spark.read.option("lineSep", "\n")
        .text(_patterns(patterns))
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row"),
            F.col("value").alias("text"),
        )
    )
    before = (
        Window.partitionBy("file")
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    blocks = (
        lines.groupBy("file", "_block")
        .agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
        .select(
            "file",
            "_block",
            (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        )
    )
    pos = F.col("_row") + F.coalesce(
        "_shift", F.raise_error(F.lit("a block of lines was not counted")).cast("bigint")
    )
    return lines.join(blocks, ["file", "_block"], "left").select(
        "file", pos.alias("pos"), "text"
    )


def sentences_from_texts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, text): the lower-cased sentences of each text; a text plays the file's part."""
    # The outer form keeps the optimizer from splitting every text a second time, for a filter
    # on the array's size.
    parts = F.posexplode_outer(split_sentences(F.lower(text)))
    return df.select(key, parts.alias("pos", "text")).filter(F.col("pos").isNotNull())


def sentence_arrays(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, sentences): per text an array of token arrays, for the operators without shuffle."""
    return df.select(
        key, F.transform(split_sentences(F.lower(text)), ws_tokens).alias("sentences")
    )


def _field(line: Column, sep: str, i: int) -> Column:
    return F.get(F.split(line, sep, -1), F.lit(i))


def read_captions(df: DataFrame, sep: str = TAB, line: str = "text") -> DataFrame:
    """Lines ``clip_id <sep> caption`` → (…, clip_id, tokens); no separator gives no tokens."""
    caption = _field(F.col(line), sep, 1)
    return df.select(
        *[c for c in df.columns if c != line],
        _field(F.col(line), sep, 0).alias("clip_id"),
        F.coalesce(ws_tokens(caption), F.array().cast("array<string>")).alias("tokens"),
    )


def read_pairs(df: DataFrame, line: str = "text") -> DataFrame:
    """Lines ``s1 <tab> s2`` → (…, s1, s2); only a line end is cut from the second field."""
    bare = F.regexp_replace(line, r"\r?\n?$", "")
    return df.select(
        *[c for c in df.columns if c != line],
        _field(bare, TAB, 0).alias("s1"),
        _field(bare, TAB, 1).alias("s2"),
    )


def read_labelled(df: DataFrame, line: str = "text") -> DataFrame:
    """Lines ``caption <tab> whole number`` → (…, tokens, obj_id); malformed lines are dropped."""
    label = F.trim(_field(F.col(line), TAB, 1))
    obj_id = F.when(label.rlike(r"^[+-]?[0-9]+$"), label).try_cast("int")
    return df.select(
        *[c for c in df.columns if c != line],
        clean_caption(_field(F.col(line), TAB, 0)).alias("tokens"),
        obj_id.alias("obj_id"),
    ).filter(F.col("obj_id").isNotNull())


def read_scored_pairs(
    spark: SparkSession, paths: list[str], header: bool = True
) -> DataFrame:
    """Tab-separated scored pairs, the files appended → (s1, s2, score).

    With header: columns ``id, A, B, score``; without: ``A, B, score``.
    """
    names = "s1 string, s2 string, score double"
    schema = f"pair_id string, {names}" if header else names
    read = spark.read.schema(schema).option("sep", TAB).option("quote", "")
    parts = [
        read.option("header", str(header).lower()).option("enforceSchema", "true").csv(path)
        for path in paths
    ]
    # An empty field is an empty sentence, not a missing one.
    return reduce(DataFrame.unionByName, parts).select(
        F.coalesce("s1", F.lit("")).alias("s1"), F.coalesce("s2", F.lit("")).alias("s2"), "score"
    )


def union_domains(domains: dict[str, DataFrame]) -> DataFrame:
    """Bag union of the domains' tables with a ``domain`` column; "all" is the whole result."""
    parts = [df.withColumn("domain", F.lit(name)) for name, df in domains.items()]
    return reduce(DataFrame.unionByName, parts)


def read_records(spark: SparkSession, patterns: str | list[str], kind: str) -> DataFrame:
    """Stored records of one kind, from all shards the patterns name; only typed fields."""
    if kind not in RECORDS:
        raise ValueError(f"kind must be one of {sorted(RECORDS)}, not {kind!r}")
    return spark.read.schema(RECORDS[kind]).parquet(*_patterns(patterns))
