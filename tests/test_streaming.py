"""A stream gives the same ids as a batch."""

from sentloom.functions.text import ws_tokens
from sentloom.operators.lookup import encode_ids
from sentloom.streaming.rows import encode_stream, read_lines, write_records


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.txt").write_text("\n".join(f"a {w} b{i}" for w in "abc") + "\n")
    vocab = spark.createDataFrame(
        [("<eos>", 0), ("<unk>", 1), ("a", 2), ("b", 3), ("b1", 4)], "word string, id int"
    )
    lines = read_lines(spark, str(source), files_per_trigger=1)
    query = write_records(
        encode_stream(lines, vocab, "drop", add_eos=True), str(tmp_path / "out"), str(tmp_path / "cp")
    )
    query.awaitTermination(120)
    assert query.exception() is None
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = spark.read.text(str(source)).withColumnRenamed("value", "text")
    batch = encode_ids(batch.withColumn("tokens", ws_tokens("text")), vocab, "drop", add_eos=True)
    assert sorted(map(str, streamed.select("text", "ids").collect())) == sorted(
        map(str, batch.select("text", "ids").collect())
    )
