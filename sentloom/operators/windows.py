"""Neighbouring sentences and per-group caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentloom.operators.joins import with_key
from sentloom.session import materialize


def neighbours(
    df: DataFrame,
    group: str,
    order: str,
    value: str,
    chunk_rows: int = 1_000_000,
) -> DataFrame:
    """Columns ``previous`` and ``next``: ``value`` of the row before and after in its group.

    ``order`` is an integer. The window runs over runs of ``chunk_rows`` order values, so one
    huge group is spread over many tasks. Runs exchange their edges beside it: an aggregate of the
    orders tells each run's first and last row; only if a group has several runs are these rows'
    values fetched and put among the rows of the runs before and after, so one window sees all.
    """
    run = F.floor(F.col(order) / chunk_rows)
    ends = materialize(
        df.groupBy(F.col(group).alias("_group"), run.alias("_run"))
        .agg(F.min(order).alias("first"), F.max(order).alias("last"))
        .groupBy("_group").agg(F.collect_list(F.array("first", "last")).alias("ends")).filter(F.size("ends") > 1)
        .select("_group", F.explode(F.array_distinct(F.flatten("ends"))).alias("_at"))
    )
    rows = df.withColumn("_chunk", run).withColumn("_own", F.lit(True))
    if not ends.isEmpty():
        handed = _handed(df, ends, group, order, value, run)
        rows = rows.unionByName(handed.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    window = Window.partitionBy(group, "_chunk").orderBy(order)
    # Rows without order have none after them.
    after = F.when(F.lead(order).over(window).isNotNull(), F.lead(value).over(window))
    near = rows.select("*", F.lag(value).over(window).alias("previous"), after.alias("next"))
    return near.filter("_own").drop("_chunk", "_own")


def _handed(df: DataFrame, ends: DataFrame, group: str, order: str, value: str, run: Column) -> DataFrame:
    """(group, order, value, _chunk): the last row of the run before and the first of the run after, for
    each run of the groups in ``ends``."""
    found = df.select(F.col(group).alias("_own"), F.col(order).alias("_order"), run.alias("_run"), F.col(value).alias("_value"))
    edges = (
        found.join(ends, F.col("_own").eqNullSafe(F.col("_group")) & (F.col("_order") == F.col("_at")))
        .groupBy("_group").agg(F.sort_array(F.collect_list(F.struct("_order", "_run", "_value"))).alias("r"))
        .withColumn("firsts", F.filter("r", lambda x, i: (i == 0) | (F.get("r", i - 1)["_run"] != x["_run"])))
        .withColumn("lasts", F.filter("r", lambda x, i: (i == F.size("r") - 1) | (F.get("r", i + 1)["_run"] != x["_run"])))
    )
    near = F.transform(
        "firsts",
        lambda x, i: F.struct(x["_run"].alias("run"), F.array(F.get("lasts", i - 1), F.get("firsts", i + 1)).alias("x")),
    )
    handed = edges.select("_group", F.explode(near).alias("n")).select("_group", "n.run", F.explode("n.x").alias("x"))
    return handed.filter("x is not null").select(
        F.col("_group").alias(group), F.col("x._order").alias(order), F.col("x._value").alias(value), F.col("run").alias("_chunk")
    )


def _usable(parts: list[Column]) -> Column:
    """All parts present and non-empty."""
    cond = F.lit(True)
    for part in parts:
        cond = cond & (F.size(part) > 0)
    return F.coalesce(cond, F.lit(False))


def _short(parts: list[Column], max_len: int) -> Column:
    cond = F.lit(True)
    for part in parts:
        cond = cond & ((F.size(part) < max_len) if max_len else F.lit(True))
    return cond


def triples(
    df: DataFrame,
    group: str,
    order: str,
    tokens: str = "tokens",
    max_len: int = 30,
    chunk_rows: int = 1_000_000,
) -> DataFrame:
    """(previous, current, next) token arrays inside one group.

    All three must be non-empty and shorter than ``max_len``; an empty row shifts the window
    like any other.
    """
    near = neighbours(df, group, order, tokens, chunk_rows)
    parts = [F.col("previous"), F.col(tokens), F.col("next")]
    return near.filter(_usable(parts) & _short(parts, max_len)).select(
        group,
        order,
        F.col("previous").alias("decode_pre"),
        F.col(tokens).alias("encode"),
        F.col("next").alias("decode_post"),
    )


def row_triples(
    df: DataFrame, sentences: str = "sentences", keep: list[str] | None = None
) -> DataFrame:
    """Triples when a row holds all sentences of its file, as an array: no shuffle at all.

    The elements can be anything with a size. Gives ``keep``, ``pos`` (0-based, of the current
    sentence) and the three parts, before any filter. The outer explode keeps the optimizer from
    computing the sentences a second time, for a filter on their number.
    """
    s = F.col(sentences)
    inner = F.greatest(F.size(s) - 2, F.lit(0))
    zipped = F.arrays_zip(
        F.slice(s, F.lit(1), inner).alias("decode_pre"),
        F.slice(s, F.lit(2), inner).alias("encode"),
        F.slice(s, F.lit(3), inner).alias("decode_post"),
    )
    return (
        df.select(*(keep or []), F.posexplode_outer(zipped).alias("_i", "_t"))
        .filter(F.col("_i").isNotNull())
        .select(*(keep or []), (F.col("_i") + 1).alias("pos"), "_t.*")
    )


def usable_triple(max_len: int = 30) -> Column:
    """Row condition for triples of token arrays."""
    parts = [F.col("decode_pre"), F.col("encode"), F.col("decode_post")]
    return _usable(parts) & _short(parts, max_len)


def triple_stats(near: DataFrame, tokens: str = "tokens", max_len: int = 30) -> DataFrame:
    """One row of counters (seen, considered, too long, output) over :func:`neighbours` rows."""
    parts = [F.col("previous"), F.col(tokens), F.col("next")]
    considered, short = _usable(parts), _short(parts, max_len)
    return near.agg(
        F.count("*").alias("sentences_seen"),
        F.count_if(considered).alias("sentences_considered"),
        F.count_if(considered & ~short).alias("sentences_too_long"),
        F.count_if(considered & short).alias("sentences_output"),
    )


def row_triple_stats(
    df: DataFrame, sentences: str = "sentences", max_len: int = 30
) -> DataFrame:
    """The same counters when a row holds all sentences of its file: one scan, no explode."""
    sizes = F.transform(sentences, F.size)
    inner = F.greatest(F.size("_sizes") - 2, F.lit(0))
    # The longest and the shortest of each three neighbours decide.
    spans = F.zip_with(
        F.zip_with(
            F.slice("_sizes", F.lit(1), inner),
            F.slice("_sizes", F.lit(2), inner),
            lambda a, b: F.struct(F.least(a, b).alias("least"), F.greatest(a, b).alias("most")),
        ),
        F.slice("_sizes", F.lit(3), inner),
        lambda s, c: F.struct(
            F.least(s["least"], c).alias("least"), F.greatest(s["most"], c).alias("most")
        ),
    )
    considered = F.filter("_spans", lambda s: s["least"] > 0)
    output = F.filter(
        "_spans",
        lambda s: (s["least"] > 0) & ((s["most"] < max_len) if max_len else F.lit(True)),
    )
    per_row = (
        df.select(sizes.alias("_sizes"))
        .select("_sizes", spans.alias("_spans"))
        .select(
            F.size("_sizes").alias("_seen"),
            F.size(considered).alias("_considered"),
            F.size(output).alias("_output"),
        )
    )
    return per_row.agg(
        F.sum("_seen").alias("sentences_seen"),
        F.sum("_considered").alias("sentences_considered"),
        (F.sum("_considered") - F.sum("_output")).alias("sentences_too_long"),
        F.sum("_output").alias("sentences_output"),
    )


def length_stats(df: DataFrame, tokens: list[str], max_len: int = 30) -> DataFrame:
    """The counters for loaders that look at single rows: every row is considered."""
    short = _short([F.col(t) for t in tokens], max_len)
    return df.agg(
        F.count("*").alias("sentences_considered"),
        F.count_if(~short).alias("sentences_too_long"),
        F.count_if(short).alias("sentences_output"),
    )


def caption_stats(
    captions: DataFrame,
    features: DataFrame,
    group: str = "clip_id",
    order: str | list[str] = "pos",
    tokens: str = "tokens",
    n: int = 40,
    max_len: int = 30,
) -> DataFrame:
    """One row of counters (seen, considered, too long, output) of a caption job.

    Every caption is seen; the first ``n`` of a group with a feature are considered. Only lengths
    go through the cap's shuffle.
    """
    keys = [order] if isinstance(order, str) else order
    rows = captions.select(group, *keys, F.size(tokens).alias("_size"))
    with_feature = with_key(rows, features, group)
    short = F.col("_size") < max_len if max_len else F.lit(True)
    counted = cap_per_group(with_feature, group, keys, n).agg(
        F.count("*").alias("sentences_considered"),
        F.count_if(~short).alias("sentences_too_long"),
        F.count_if(short).alias("sentences_output"),
    )
    seen = rows.agg(F.count("*").alias("sentences_seen"))
    names = seen.columns + counted.columns
    return seen.unionByName(counted, allowMissingColumns=True).agg(
        *[F.max(name).alias(name) for name in names]
    )


def cap_per_group(df: DataFrame, group: str, order: str | list[str], n: int = 40) -> DataFrame:
    """First ``n`` rows of each group in ``order``.

    Spark limits each group inside every map task before the shuffle, so a hot group moves at
    most ``n`` rows per task.
    """
    keys = [order] if isinstance(order, str) else order
    place = F.row_number().over(Window.partitionBy(group).orderBy(*keys))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def adjacent_pairs(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Pairs of one group's rows that follow each other: linear in the group's size."""
    return (
        neighbours(df, group, order, value)
        .filter(F.col("next").isNotNull())
        .select(group, order, F.col(value).alias("s1"), F.col("next").alias("s2"))
    )
