"""Line dedup by levelled sorted runs of line hashes.

A run is a table of line hashes, each with the number of documents and of lines that have it. It is
bucketed and sorted by the hash, so runs meet in merge joins without a shuffle. A new batch is
anti-joined with the lines that the runs already know to be frequent, and the rest becomes a run of
level 0. Two runs of a level are merged into one of the next, so that there are never more runs
than the logarithm of the number of batches.

Documents meet their frequent lines by position: only hashes are shuffled for that, and the kept
lines are cut out between the dropped positions, in time linear in the document.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentloom.llm.common import free_name, let, lookup_join
from sentloom.session import checkpoint_root, materialize

#: Stripped at both ends of a line.
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_DOCS, MIN_CHARS = 10, 1
BATCHES = 4
KEY = ["h1", "h2"]


def split_lines(text: Column | str) -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column | str) -> Column:
    """A key per line: stripped, A-Z lower-cased. ASCII lines take the quick way."""
    bare = F.transform(split_lines(text), lambda line: F.btrim(line, F.lit(SPACES)))
    return F.transform(
        bare,
        lambda b: F.when(F.octet_length(b) == F.length(b), F.lower(b)).otherwise(F.translate(b, UPPER, LOWER)),
    )


def _hash(*columns: Column | str) -> list[Column]:
    """128 bits, as two hashes of different seeds."""
    return [F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit(1), *columns).alias("h2")]


def line_counts(df: DataFrame, text_col: str, min_chars: int = MIN_CHARS, *carry: str) -> DataFrame:
    """(carry, h1, h2, n_docs, n_lines) of the keys of at least ``min_chars`` code points. Each row is
    a document. A document's keys are sorted, so the first of equal ones counts it; a hot line is
    one row per map task in the shuffle."""
    marked = let(
        F.sort_array(F.col("_keys")),
        lambda s: F.transform(
            s, lambda key, i: F.struct(key.alias("key"), ((i == 0) | (F.get(s, i - 1) != key)).alias("first"))
        ),
    )
    lines = df.select(*carry, line_keys(text_col).alias("_keys")).select(*carry, F.explode_outer(marked).alias("_line"))
    return (
        lines.filter(F.length("_line.key") >= min_chars)
        .select(*carry, *_hash("_line.key"), F.col("_line.first").cast("bigint").alias("first"))
        .groupBy(*carry, *KEY)
        .agg(F.sum("first").alias("n_docs"), F.count("*").alias("n_lines"))
    )


class LineRuns:
    """Levels of sorted runs (h1, h2, n_docs, n_lines), kept as bucketed tables in the shared folder.

    A line of ``min_docs`` documents or more is settled: later batches leave it out. All other
    counts add up when runs are merged, so no count is lost.
    """

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS) -> None:
        self.spark, self.min_docs = spark, min_docs
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.root = checkpoint_root(spark).rstrip("/")
        self.levels: list[DataFrame | None] = []
        self.names: list[str] = []

    def add(self, counts: DataFrame) -> None:
        """A batch: at most one row per hash."""
        fresh = counts.select(*KEY, "n_docs", "n_lines").repartition(self.buckets, *KEY)
        for run in self.levels:
            if run is not None:
                settled = run.filter(F.col("n_docs") >= self.min_docs).select(*KEY)
                fresh = fresh.join(settled.hint("merge"), KEY, "left_anti")
        run = self._store(fresh)
        for level, there in enumerate(self.levels):
            if there is None:
                self.levels[level] = run
                return
            run = self._store(self._merged(there, run))
            self.levels[level] = None
        self.levels.append(run)

    def settled(self) -> DataFrame:
        """The lines of at least ``min_docs`` documents, with the lines counted until they were."""
        runs = [run for run in self.levels if run is not None]
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long, n_docs long, n_lines long")
        return reduce(self._merged, runs).filter(F.col("n_docs") >= self.min_docs)

    def close(self) -> None:
        """Forget the tables' names."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _store(self, rows: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            rows.write.format("parquet").option("path", f"{self.root}/{name}")
            .bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        )
        self.names.append(name)
        return self.spark.table(name)

    @staticmethod
    def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
        other = b.withColumnsRenamed({"n_docs": "_docs", "n_lines": "_lines"})
        zero = F.lit(0).cast("bigint")
        return a.join(other.hint("merge"), KEY, "full_outer").select(
            *KEY,
            (F.coalesce("n_docs", zero) + F.coalesce("_docs", zero)).alias("n_docs"),
            (F.coalesce("n_lines", zero) + F.coalesce("_lines", zero)).alias("n_lines"),
        )


def frequent_lines(
    df: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES
) -> DataFrame:
    """(h1, h2, n_docs, n_lines): stored hashes of the lines of at least ``min_docs`` rows of ``df``,
    which goes through the runs in ``batches`` by its texts' hashes. The runs stop counting a line
    once it is settled; the counts returned are of all rows."""
    batch = F.pmod(F.xxhash64(text_col), F.lit(batches)).alias("_batch")
    rows = df.select(batch, F.col(text_col).alias("_text"))
    counts = materialize(line_counts(rows, "_text", min_chars, "_batch").sortWithinPartitions("_batch"))
    runs = LineRuns(df.sparkSession, min_docs)
    for number in range(batches):
        runs.add(counts.filter(F.col("_batch") == number))
    settled = materialize(runs.settled().select(*KEY))
    runs.close()
    return materialize(
        counts.join(settled, KEY, "left_semi").groupBy(*KEY)
        .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_lines").alias("n_lines"))
    )


def drop_frequent_lines(
    df: DataFrame,
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    batches: int = BATCHES,
    out: tuple[str, str, str] = ("n_lines", "n_dropped", "kept"),
) -> DataFrame:
    """All columns of ``df`` and three more: lines before dropping, lines dropped, and the text of the
    kept lines.

    Each row is a document, whatever its id; repeated rows count one by one. Null and empty texts
    are one empty line, whose key is too short to be dropped. Columns of ``df`` named as one of
    ``out``, in any case, are replaced. An empty table gives an empty result.
    """
    taken = {c.lower() for c in out}
    rows = df.select(*[c for c in df.columns if c.lower() not in taken or c == text_col])
    found = frequent_lines(df, text_col, min_docs, min_chars, batches)
    key = free_name(rows, "text_key")
    # Equal texts lose the same lines, so they share their dropped positions. A text without any
    # long enough key has none, and its copies need not meet.
    some = F.length(F.btrim(F.col(text_col), F.lit(SPACES))) > 0
    if min_chars > 1:
        some = F.exists(line_keys(text_col), lambda k: F.length(k) >= min_chars)
    text_key = F.when(some, F.struct(*[h.cast("bigint").alias(n) for n, h in zip(("a", "b"), _hash(text_col), strict=True)]))
    places = (
        # The key in a step of its own: beside the explode it would be computed per line.
        rows.select(text_key.alias("text_key"), line_keys(text_col).alias("lines"))
        .select("text_key", F.posexplode_outer("lines").alias("pos", "line"))
        .filter(F.length("line") >= min_chars)
        .select("text_key", "pos", F.struct(*_hash("line")).alias("hash"))
    )
    hashes = found.select(F.struct(*KEY).alias("hash"), F.col("n_lines").alias("n"), F.lit(True).alias("hit"))
    hits = lookup_join(places, hashes, "hash", "n", "text_key").filter("hit")
    dropped = materialize(
        hits.groupBy("text_key").agg(F.sort_array(F.collect_set("pos")).alias("places"), F.count("*").alias("n_hits"))
        .select(F.col("text_key").alias(key), "places", (F.col("n_hits") / F.size("places")).cast("bigint").alias("copies"))
    )
    places_col, copies = free_name(rows, "places"), free_name(rows, "copies")
    dropped = dropped.withColumnsRenamed({"places": places_col, "copies": copies})
    joined = lookup_join(rows.withColumn(key, text_key), dropped, key, copies, key)
    lines = split_lines(text_col)
    n_dropped = F.coalesce(F.size(places_col), F.lit(0))
    kept = F.when(F.col(places_col).isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(_between(lines, F.col(places_col)))
    results = [F.size(lines).cast("bigint"), n_dropped.cast("bigint"), kept]
    kept_columns = [c for c in rows.columns if c.lower() not in taken]
    return joined.select(*kept_columns, *[r.alias(name) for r, name in zip(results, out, strict=True)])


def _between(lines: Column, places: Column) -> Column:
    """The lines that are not at ``places`` (ascending, from 0), joined: slices between them."""
    def cut(both: Column) -> Column:
        # Place -1 stands before the first line, the number of lines behind the last.
        edges = F.concat(F.array(F.lit(-1)), both["places"], F.array(F.size(both["lines"])))
        return let(
            F.struct(both["lines"].alias("lines"), edges.alias("edges")),
            lambda x: F.flatten(
                F.transform(
                    F.sequence(F.lit(1), F.size(x["edges"]) - 1),
                    lambda i: F.slice(x["lines"], F.get(x["edges"], i - 1) + 2, F.get(x["edges"], i) - F.get(x["edges"], i - 1) - 1),
                )
            ),
        )

    return F.array_join(let(F.struct(lines.alias("lines"), places.alias("places")), cut), "\n")
