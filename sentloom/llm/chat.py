"""Preference formatting of chat, in DataFrame functions only.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns is rendered
once, as the prompt; what follows in each is its completion. A completion's mask is the spans (in
code points) of assistant words and their end marks; headers and other roles are not trained on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentloom.llm.common import let

HEAD, BODY, END = "<|", "|>\n", "<|end|>"
TRAINED_ROLE = "assistant"
TURNS = "array<struct<role:string,text:string>>"


def collect_turns(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per conversation: ``conv_id`` and ``turns`` in the order of their numbers (turns of
    equal or null numbers by role, then text; a null role is "", a null text is empty)."""
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    grouped = df.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
    )


def common_prefix(a: Column, b: Column) -> Column:
    """The number of leading turns that two conversations share."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y)
    return let(
        F.struct(F.array_position(same, F.lit(False)).alias("at"), n.alias("n")),
        lambda x: F.when(x["at"] > 0, x["at"] - 1).otherwise(x["n"]).cast("int"),
    )


def _safe(text: Column) -> Column:
    """A turn's words can't close it or open another."""
    return F.replace(text, F.lit(HEAD), F.lit("< |"))


def _pieces(turns: Column) -> Column:
    """Per turn, its header and the rest with the end mark."""
    return F.transform(
        turns,
        lambda t: F.struct(
            F.concat(F.lit(HEAD), _safe(t["role"]), F.lit(BODY)).alias("head"),
            F.concat(_safe(t["text"]), F.lit(END)).alias("body"),
            (t["role"] == TRAINED_ROLE).alias("trained"),
        ),
    )


def render(turns: Column) -> Column:
    return F.array_join(F.transform(_pieces(turns), lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "")


def trained_spans(turns: Column) -> Column:
    """(start, end) of what is trained on in ``render(turns)``."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        head = acc["at"] + F.length(p["head"])
        end = head + F.length(p["body"])
        span = F.array(F.struct(head.alias("start"), end.alias("end")))
        return F.struct(
            (end + 1).alias("at"),
            F.when(p["trained"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(_pieces(turns), start, step, lambda acc: acc["spans"])


def format_preferences(pairs: DataFrame, chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """``pairs`` with arrays of turns replaced by ``prompt_turns``, ``prompt``, ``chosen``,
    ``rejected``, ``chosen_spans`` and ``rejected_spans``.

    A missing (null or empty) conversation has no turns: the prompt is empty and so is its
    completion. Equal conversations are all prompt, with empty completions. No shuffle.
    """
    empty = F.array().cast(TURNS)
    others = [c for c in pairs.columns if c not in (chosen_col, rejected_col)]
    both = pairs.select(
        *others,
        F.coalesce(chosen_col, empty).alias("_chosen"),
        F.coalesce(rejected_col, empty).alias("_rejected"),
    ).withColumn("_n", common_prefix(F.col("_chosen"), F.col("_rejected")))

    def rest(c: str) -> Column:
        return F.slice(F.col(c), F.col("_n") + 1, F.size(c))

    return both.select(
        *others,
        F.col("_n").alias("prompt_turns"),
        render(F.slice(F.col("_chosen"), F.lit(1), F.col("_n"))).alias("prompt"),
        render(rest("_chosen")).alias("chosen"),
        render(rest("_rejected")).alias("rejected"),
        trained_spans(rest("_chosen")).alias("chosen_spans"),
        trained_spans(rest("_rejected")).alias("rejected_spans"),
    )


def answer_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs from single conversations (``conv_id``, ``turns``): chosen is a conversation up to its last
    assistant turn; rejected is the same with that turn taken from the partner, the conversation
    whose integer id differs in the lowest bit. One row per conversation; without an assistant turn
    ``chosen`` is null, without a partner's ``rejected`` is. Ids in pairs are unique, so no
    key is hot."""
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == TRAINED_ROLE, i)))
    cut = conversations.select("conv_id", F.slice("turns", F.lit(1), last + 1).alias("chosen"))
    answers = cut.select(
        F.col("conv_id").bitwiseXOR(F.lit(1).cast("bigint")).alias("_id"),
        F.element_at(F.filter("chosen", lambda t: t["role"].isNotNull()), -1).alias("answer"),
    ).filter(F.col("answer").isNotNull() & F.col("_id").isNotNull())
    rejected = F.concat(F.slice("chosen", F.lit(1), F.size("chosen") - 1), F.array("answer"))
    return cut.join(answers, F.col("conv_id") == F.col("_id"), "left").select(
        "conv_id", "chosen",
        F.when(F.col("answer").isNotNull() & F.col("chosen").isNotNull(), rejected).alias("rejected"),
    )
