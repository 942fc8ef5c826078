"""Row-wise operators on streaming DataFrames.

Tokenising, id encoding and sentence encoding look at one row at a time and keep no state, so
they run on a stream as they are; the word table is a stored batch table. Operators that rank
or look at neighbouring rows are for batch tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from sentloom.functions.text import ws_tokens
from sentloom.operators.lookup import encode_ids


def read_lines(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New text files below ``path``, as lines."""
    return (
        spark.readStream.format("text")
        .option("lineSep", "\n")
        .option("maxFilesPerTrigger", str(files_per_trigger))
        .load(path)
        .withColumnRenamed("value", "text")
    )


def encode_stream(
    lines: DataFrame, vocab: DataFrame, oov: str = "unk", add_eos: bool = False
) -> DataFrame:
    """Lines → ids, no state and no shuffle."""
    tokens = lines.withColumn("tokens", ws_tokens("text"))
    return encode_ids(tokens, vocab, oov, "tokens", "ids", add_eos)


def write_records(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, exactly once, until the input is used up."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
