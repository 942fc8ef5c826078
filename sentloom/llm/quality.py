"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit
per rule; policies are versioned sets of rules, applied to the stored bits, and ablations are sums
over the bits. A new policy or threshold study never reads a text again.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentloom.llm.common import free_name, slices

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
SYMBOLS = b"#*$%&|<>"

#: A rule's place in this list is its bit; new rules go to the end. Whole numbers only.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
]
#: The policy versions: rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "1": ("few_words", "repeated_words", "symbols", "repeated_lines"),
    "2": tuple(name for name, _ in RULES),
}


def _measure(text: bytes) -> tuple[int, ...]:
    words = text.split()  # of bytes: at the ASCII white space only
    n = len(words)
    chars = len(text.decode()) - (len(text) - sum(map(len, words)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        hit = bytearray(n)
        for i, window in enumerate(windows):
            if counts[window] > 1:
                hit[i : i + 3] = b"\1\1\1"
        repeated = sum(hit)
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def measure(df: DataFrame, text_col: str, carry: list[str], prefix: str = "") -> DataFrame:
    """The columns ``carry`` and the measurements of the text, named with ``prefix``. No shuffle."""
    names = [prefix + name for name in MEASURES]
    schema = T.StructType(
        [df.schema[c] for c in carry] + [T.StructField(name, T.LongType()) for name in names]
    )

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, batch.num_columns - 1):
                columns = zip(*map(_measure, texts), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *[pa.array(c, pa.int64()) for c in columns]],
                    names=[*carry, *names],
                )

    return df.select(*carry, F.col(text_col).alias(free_name(df, "text"))).mapInArrow(measured, schema)


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, the measurements, and ``failed``, one bit per failed rule.

    A null text counts as empty: no words, so ``few_words`` fails. Ids may be null or repeated;
    each row is judged on its own. Other columns of ``df`` are not read. An empty table gives an
    empty ledger.
    """
    found = measure(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", ["doc_id"])
    return found.withColumn("failed", failure_bits())


def keep_passing(df: DataFrame, version: str = "2", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that pass a policy version, with their columns as they are."""
    prefix = "_quality_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    found = measure(df, text_col, df.columns, prefix).withColumn(prefix + "failed", failure_bits(prefix))
    return found.filter(passes(version, prefix + "failed")).select(*df.columns)


def failure_bits(prefix: str = "") -> Column:
    """The rules' bits as one long, from the measurements."""
    bits = F.lit(0).cast("bigint")
    for place, (_, rule) in enumerate(RULES):
        one = F.lit(1 << place).cast("bigint")
        bits = bits.bitwiseOR(F.when(F.expr(re.sub(r"[a-z]\w*", prefix + r"\g<0>", rule)), one).otherwise(F.lit(0).cast("bigint")))
    return bits


def policy_mask(version: str) -> int:
    places = {name: place for place, (name, _) in enumerate(RULES)}
    return sum(1 << places[name] for name in POLICIES[version])


def passes(version: str = "2", failed: str = "failed") -> Column:
    """Whether a document passes a policy version; only its stored bits are looked at."""
    return F.col(failed).bitwiseAND(F.lit(policy_mask(version)).cast("bigint")) == 0


def ablation(ledger_df: DataFrame, version: str = "2") -> DataFrame:
    """For each rule of a policy: documents it rejects, and those that only it rejects (which
    come back without it). Bits are counted first, so at most 2^rules rows are looked at."""
    mask = F.lit(policy_mask(version)).cast("bigint")
    counts = (
        ledger_df.groupBy(F.col("failed").bitwiseAND(mask).alias("bits"))
        .agg(F.count("*").alias("n"))
    )
    rules = [(name, 1 << i) for i, (name, _) in enumerate(RULES) if name in POLICIES[version]]
    each = F.explode(
        F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).alias("bit")) for n, b in rules])
    )
    bit = F.col("r.bit").cast("bigint")
    return (
        counts.select("bits", "n", each.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(bit) != 0, F.col("n")).otherwise(0)).alias("rejects"),
            F.sum(F.when(F.col("bits") == bit, F.col("n")).otherwise(0)).alias("alone"),
        )
    )
