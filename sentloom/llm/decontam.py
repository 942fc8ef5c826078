"""Benchmark decontamination by winnowing, in DataFrame functions only.

A text's words give k-gram hashes; of every ``WINDOW - k + 1`` consecutive hashes the least is a
fingerprint. Those hashes span exactly one window of ``WINDOW`` words, so a window that a document
shares with an item has the same least hash in both: no shared window is missed. Documents'
fingerprints meet the benchmark's in a join; only where one hits are the window's own words
compared (the extension), so a hash collision costs time and never a wrong hit.

Items shorter than a window are one window of their length m; documents get fingerprints for each
length that occurs in the benchmark (at most ``WINDOW`` lengths).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentloom.llm.common import let
from sentloom.session import materialize

WINDOW = 10
GRAM = 5
#: The benchmark's fingerprints are sent to all executors up to this many (16 bytes each); beyond
#: it the same join is a shuffle.
BROADCAST_ROWS = 2_000_000

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text after lower-casing A-Z; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(low, _SEPARATORS), lambda w: w != "")


def _count_words(text: Column) -> Column:
    """The number of words, without making them: case does not matter, so separators are those
    outside A-Z too."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    return let(
        parts,
        lambda p: F.size(p)
        - F.when(p[0] == "", 1).otherwise(0)
        - F.when((F.size(p) > 1) & (F.element_at(p, -1) == ""), 1).otherwise(0),
    )


def _gram_hashes(words: Column, k: int) -> Column:
    """Hashes of the k-grams by position; fewer than k words give none."""
    last = F.size(words) - k
    return F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[words[i + j] for j in range(k)])),
    ).otherwise(F.array().cast("array<bigint>"))


def _least(hashes: Column, width: int) -> Column:
    """The least hash of every ``width`` consecutive ones, by position."""
    if width == 1:
        return hashes
    last = F.size(hashes) - width
    return F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), last), lambda i: F.least(*[hashes[i + j] for j in range(width)])),
    ).otherwise(F.array().cast("array<bigint>"))


def _window_prints(words: Column, lengths: list[int]) -> Column:
    """Per length m: (m, least hash of the window at each position)."""
    grams = sorted({min(GRAM, m) for m in lengths})
    arrays = F.array(*[_gram_hashes(words, k) for k in grams])
    return let(
        arrays,
        lambda g: F.array(
            *[
                F.struct(F.lit(m).alias("m"), _least(g[grams.index(min(GRAM, m))], m - min(GRAM, m) + 1).alias("prints"))
                for m in lengths
            ]
        ),
    )


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per window of the benchmark: ``m`` words, ``window`` (words joined by a space),
    ``print`` and ``items`` (ids as strings). Bounded by the benchmark; hot windows are grouped."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), words_of(F.col(text_col)).alias("words"))
    items = items.filter(F.size("words") > 0).withColumn("m", F.least(F.size("words"), F.lit(WINDOW)))
    each = items.select(
        "item", "m",
        F.explode(let(F.struct("words", "m"), lambda x: F.transform(
            F.sequence(F.lit(0), F.size(x["words"]) - x["m"]),
            lambda s: F.slice(x["words"], s + 1, x["m"]),
        ))).alias("words"),
    )
    lengths = list(range(1, WINDOW + 1))
    return (
        each.groupBy("m", "words").agg(F.sort_array(F.collect_set("item")).alias("items"))
        .select("m", F.array_join("words", " ").alias("window"), "items",
                let(F.col("words"), lambda w: _own_print(w, lengths)).alias("print"))
    )


def _own_print(words: Column, lengths: list[int]) -> Column:
    """The print of a window that is all of ``words``."""
    found = None
    for m in lengths:
        k = min(GRAM, m)
        value = F.least(*[F.xxhash64(*[words[i + j] for j in range(k)]) for i in range(m - k + 1)]) if m > k else F.xxhash64(*[words[j] for j in range(k)])
        found = F.when(F.size(words) == m, value) if found is None else found.when(F.size(words) == m, value)
    return found


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document row with a hit: ``doc_id``, ``text_key``, ``n_hit`` (words inside an
    occurring window), ``items`` (ids as strings, sorted) and ``hits`` (starts and lengths).

    Rows are told apart by id and a hash of the text, so rows with equal ids and other texts stay
    apart, and repeated rows come out once. Null ids are ids like others; null texts have no words.
    An empty benchmark or table gives no rows.
    """
    windows = materialize(benchmark_windows(benchmark))
    lengths = sorted(row.m for row in windows.select("m").distinct().collect())  # WINDOW at most
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    source = source.withColumn("text_key", F.xxhash64("text"))
    if not lengths:
        lengths = [WINDOW]
    prints = windows.select("m", F.col("print")).distinct()
    if prints.count() <= BROADCAST_ROWS:
        prints = F.broadcast(prints)

    words = words_of(F.col("text"))
    selected = let(words, lambda w: F.flatten(F.transform(
        _window_prints(w, lengths),
        lambda p: F.transform(F.array_distinct(p["prints"]), lambda h: F.struct(p["m"].alias("m"), h.alias("print"))),
    )))
    hit = materialize(
        source.select("doc_id", "text_key", F.explode(selected).alias("p")).select("doc_id", "text_key", "p.*")
        .join(prints, ["m", "print"]).select("doc_id", "text_key").distinct()
    )

    def placed(w: Column) -> Column:
        """All windows of a text, each with its print: linear in the text."""
        return F.flatten(F.transform(_window_prints(w, lengths), lambda p: F.transform(p["prints"], lambda h, i: F.struct(
            p["m"].alias("m"), h.alias("print"), i.alias("start"), F.array_join(F.slice(w, i + 1, p["m"]), " ").alias("window"),
        ))))

    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_key").eqNullSafe(F.col("_key"))
    named = [F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")]
    candidates = source.join(hit.select(*named), same)
    extended = (
        candidates.select("doc_id", "text_key", F.explode(let(words, placed)).alias("c")).select("doc_id", "text_key", "c.*")
        .join(prints, ["m", "print"])
    )
    # Windows of one passage mostly have the same items, so a hit carries the name of the set.
    set_name = F.struct(F.xxhash64("items").alias("a"), F.xxhash64(F.lit(1), "items").alias("b"))
    sets = windows.select(set_name.alias("set"), "items").dropDuplicates(["set"])
    hits = extended.join(windows.select("m", "window", set_name.alias("set")), ["m", "window"])
    covered = F.array_distinct(F.flatten(F.transform(
        "hits", lambda h: F.sequence(h["start"], h["start"] + h["m"] - 1))))
    grouped = materialize(
        hits.groupBy("doc_id", "text_key")
        .agg(F.array_sort(F.collect_set(F.struct("start", "m"))).alias("hits"), F.collect_set("set").alias("sets"))
    )
    items = (
        grouped.select(*named, F.explode("sets").alias("set")).join(sets, "set").select("_id", "_key", F.explode("items").alias("item"))
        .groupBy("_id", "_key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    return grouped.join(items, same).select(
        "doc_id", "text_key", "hits", "items", F.size(covered).cast("bigint").alias("n_hit")
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A verdict per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit``, ``items`` and
    ``contaminated``; documents without a hit have no items. Texts are not shuffled for it, but
    for those that hit a fingerprint."""
    found = find_contamination(docs, benchmark, id_col, text_col)
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "n_hit", "items")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("text_key"),
        _count_words(F.col(text_col)).cast("bigint").alias("n_words"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_key").eqNullSafe(F.col("_key"))
    return rows.join(found, same, "left").select(
        "doc_id", "text_key", "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )
