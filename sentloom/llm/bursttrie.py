"""Prefix trie of conversations as a burst trie.

Conversations are sequences of turn ids (128-bit hashes of role and text). Equal sequences are folded
to one row. All rows start as suffixes in the container of the root. A container with too many
suffixes is burst by next turn id: the suffixes move, one turn shorter, to a container per turn,
whose head hangs below the burst one. When no container is too large, each is sorted and swept
once into its nodes, by a stack that follows the longest common prefix of neighbours. Burst
containers are then put together from their children's totals, last ones first, by plain
aggregates, so a head with very many children is no task's burden.

A sequence is cut into pieces of ``PIECE`` turns, so that no row holds an unbounded conversation. A
cut is a head like a burst: the next piece's container is named by the hash of all pieces before
it, and its totals come back as a link at the end of the piece. Pieces are done last ones first;
shorter conversations need one turn of that loop.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentloom.llm.common import lookup_join
from sentloom.session import materialize

#: Suffixes of a container that is swept in one task.
LIMIT = 20_000
#: Containers over the limit are at most this many: the limit grows with the rows.
MAX_BURST = 100_000
#: Turns of one piece.
PIECE = 4096
#: Conversation ids joined to one string before hashing, as a power of two.
ID_BITS = 12
ROOT = "root"
_ROW_BITS = 33

TURN = "struct<a: bigint, b: bigint, n: bigint>"
TOTAL = "conv bigint, n bigint, children bigint, leaves bigint, saved bigint, ends string"
SWEPT = f"head string, depth bigint, parent_conv bigint, total boolean, {TOTAL}"


def rank_turns(turns: DataFrame) -> DataFrame:
    """(conv, pos, a, b, n, n_own): every turn with its place in its conversation, from 0, by turn
    (null first), role and text; null role or text is empty. Rows without a conv_id take no part.

    The place is a global rank less that of the conversation's first turn. All rows are sorted by
    range, so a conversation of any length is spread over tasks.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    keys = ["conv", "turn", "role", "text", "_any"]
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv"), "turn", role.alias("role"), text.alias("text"),
        F.monotonically_increasing_id().alias("_any"),  # lets equal rows go apart
    )
    placed = materialize(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
            "conv", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"),
            F.length("text").cast("bigint").alias("n"), F.monotonically_increasing_id().alias("row"),
        )
    )
    part = F.shiftright("row", _ROW_BITS)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    numbered = materialize(
        placed.withColumn("part", part).join(F.broadcast(starts), "part")
        .withColumn("rank", F.col("before") + F.col("row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .select("conv", "rank", "a", "b", "n")
    )
    first = numbered.groupBy("conv").agg(F.min("rank").alias("first"), F.count("*").alias("n_own"))
    first = first.withColumn("n_rows", F.col("n_own"))
    return lookup_join(numbered, first, "conv", "n_rows", "rank").select(
        "conv", (F.col("rank") - F.col("first")).alias("pos"), "a", "b", "n", "n_own"
    )


def rebuild(ranked: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """(conv, pos, a, b, n, size): the first h turns of conversation ``conv - conv % group``, then the
    conversation's own after its first h, with h = crc32(conv) % ``most``. Conversations that
    end up without turns have one row, of pos -1 and size 0."""
    convs = materialize(ranked.groupBy("conv").agg(F.max("n_own").alias("n_own"))).withColumns(
        {"base": F.col("conv") - F.col("conv") % group, "h": F.crc32(F.col("conv").cast("string")) % most}
    )
    bases = convs.select(F.col("conv").alias("base"), F.col("n_own").alias("n_base"))
    sized = materialize(
        convs.join(bases, "base", "left")
        .withColumn("n_prefix", F.least("h", F.coalesce("n_base", F.lit(0))))
        .withColumn("size", F.col("n_prefix") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0)))
    )
    # At most ``most`` turns of a base, each met by fewer than 2 * ``group`` conversations.
    starts = ranked.filter((F.col("conv") % group == 0) & (F.col("pos") < most)).select(
        F.col("conv").alias("base"), "pos", "a", "b", "n"
    )
    prefix = sized.join(starts, "base").filter("pos < h").select("conv", "pos", "a", "b", "n", "size")
    about = sized.select("conv", "h", "n_prefix", "size", "n_own")
    own = lookup_join(ranked.drop("n_own"), about, "conv", "n_own", "pos").filter("pos >= h").select(
        "conv", (F.col("pos") - F.col("h") + F.col("n_prefix")).alias("pos"), "a", "b", "n", "size"
    )
    none = F.lit(0).cast("bigint")
    empty = sized.filter("size = 0").select(
        "conv", F.lit(-1).cast("bigint").alias("pos"), none.alias("a"), none.alias("b"), none.alias("n"), "size"
    )
    return prefix.unionByName(own).unionByName(empty)


def _pieces(rows: DataFrame, size: int) -> DataFrame:
    """(conv, k, last, head, next, turns): turns ``k * size`` on of a conversation; ``head`` names all
    pieces before, ``next`` those and this one."""
    turn = F.struct("pos", "a", "b", "n")
    grouped = rows.groupBy("conv", F.floor(F.greatest("pos", F.lit(0)) / size).alias("k")).agg(
        F.sort_array(F.collect_list(F.when(F.col("pos") >= 0, turn))).alias("t"), F.max("size").alias("size")
    )
    turns = F.transform("t", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["n"].alias("n"))).cast(f"array<{TURN}>")
    # What ends at a cut belongs to the container behind it, as an empty suffix: then a head's
    # container has all members of its node.
    at_cut = rows.filter((F.col("pos") == F.col("size") - 1) & (F.col("size") > 0) & (F.col("size") % size == 0)).select(
        "conv", ((F.col("pos") + 1) / size).cast("bigint").alias("k"), F.lit(True).alias("last"), F.array().cast(f"array<{TURN}>").alias("turns")
    )
    pieces = materialize(
        grouped.select("conv", "k", ((F.col("k") + 1) * size > F.col("size")).alias("last"), turns.alias("turns")).unionByName(at_cut)
    )
    so_far = Window.partitionBy("conv").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)

    def name(seed: int) -> Column:
        own = F.xxhash64(F.lit(seed), "k", "turns")
        return F.struct(F.bit_xor(own).over(so_far).alias("all"), own.alias("own"))

    def hexed(k: Column, *parts: Column) -> Column:
        return F.when(k == 0, ROOT).otherwise(F.concat_ws("-", k.cast("string"), *[F.hex(p) for p in parts]))

    k = F.col("k")
    cut = pieces.filter("k > 0 or not last").withColumns({"x": name(1), "y": name(2)}).select(
        "conv", "k", "last",
        hexed(k, F.col("x.all").bitwiseXOR(F.col("x.own")), F.col("y.all").bitwiseXOR(F.col("y.own"))).alias("head"),
        hexed(k + 1, F.col("x.all"), F.col("y.all")).alias("next"), "turns",
    )
    whole = pieces.filter("k = 0 and last").select(
        "conv", "k", "last", F.lit(ROOT).alias("head"), F.lit(None).cast("string").alias("next"), "turns"
    )
    return whole.unionByName(cut)


def _ends(last: DataFrame) -> DataFrame:
    """(k, head, turns, conv, n, ends): one row per different sequence: its smallest conversation, their
    number, and the hash of all their ids in ascending order.

    Ids are joined to strings by ranges of 2^``ID_BITS`` ids in parallel. One hash over a sequence's
    ids can only be computed in order; a task streams the strings of its sequences through it.
    """
    key = [F.xxhash64(F.lit(s), "head", "turns").alias(n) for n, s in (("s1", 1), ("s2", 2))]
    joined = (
        last.groupBy(*key, F.shiftright("conv", ID_BITS).alias("part"))
        .agg(
            F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"),
            F.min("conv").alias("conv"), F.count("*").alias("n"), F.any_value("k").alias("k"),
            F.any_value("head").alias("head"), F.any_value("turns").alias("turns"),
        )
    )
    parts = materialize(joined)
    hashed = (
        parts.select("s1", "s2", "part", "ids").repartition("s1", "s2").sortWithinPartitions("s1", "s2", "part")
        .select("s1", "s2", "ids").mapInArrow(_hash_ids, "s1 bigint, s2 bigint, ends string")
    )
    folded = parts.groupBy("s1", "s2").agg(
        F.min("conv").alias("conv"), F.sum("n").alias("n"), F.any_value("k").alias("k"),
        F.any_value("head").alias("head"), F.any_value("turns").alias("turns"),
    )
    return folded.join(hashed, ["s1", "s2"]).select("k", "head", "turns", "conv", "n", "ends")


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state = None, sha256()

    def row(key: tuple, state) -> tuple:
        return (*key, state.hexdigest())

    for batch in batches:
        done = []
        for now, ids in zip(zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True), batch.column(2).to_pylist(), strict=True):
            if now != key:
                if key is not None:
                    done.append(row(key, state))
                key, state = now, sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _hashed(done)
    if key is not None:
        yield _hashed([row(key, state)])


def _hashed(rows: list[tuple]) -> pa.RecordBatch:
    names = ["s1", "s2", "ends"]
    kinds = [pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


class _Node:
    """An open node of the sweep; ``below`` holds its children's rows until its own conv is known."""

    __slots__ = ("below", "children", "conv", "depth", "ends", "leaves", "length", "n", "saved", "turn")

    def __init__(self, turn: tuple | None, length: int, depth: int) -> None:
        self.turn, self.length, self.depth = turn, length, depth
        self.conv, self.n, self.children, self.leaves, self.saved, self.ends = None, 0, 0, 0, 0, None
        self.below: list[list] = []

    def add(self, conv: int, n: int, children: int = 0, leaves: int = 0, saved: int = 0) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.n, self.children = self.n + n, self.children + children
        self.leaves, self.saved = self.leaves + leaves, self.saved + saved

    def row(self) -> list:
        """Totals of the subtree; a node without children is its own leaf."""
        return [self.conv, self.n, self.children, self.leaves or 1, self.saved + (self.n - 1) * self.length, self.ends]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (head, depth, a, b, len, conv, n, children, leaves, saved, ends) by head and suffix →
    nodes below the heads, and a total per head."""
    head, path, out = None, [], []

    def close() -> None:
        """Close the deepest node into its parent, and give out its children."""
        node = path.pop()
        out.extend([head, node.depth + 1, node.conv, False, *row] for row in node.below)
        row = node.row()
        if path:
            path[-1].add(node.conv, node.n, 1, row[3], row[4])
            path[-1].below.append(row)
        else:
            out.append([head, node.depth, None, True, *row])

    for batch in batches:
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        lists = [column[c].to_pylist() for c in ("a", "b", "len")]
        numbers = zip(*(column[c].to_pylist() for c in ("head", "depth", "conv", "n", "children", "leaves", "saved", "ends")), strict=True)
        for i, (now, depth, conv, n, children, leaves, saved, ends) in enumerate(numbers):
            if now != head:
                while path:
                    close()
                head, path = now, [_Node(None, 0, depth)]
            turns = list(zip(lists[0][i], lists[1][i], strict=True))
            same = 0
            while same < len(turns) and same + 1 < len(path) and path[same + 1].turn == turns[same]:
                same += 1
            while len(path) > same + 1:
                close()
            for at in range(same, len(turns)):
                path.append(_Node(turns[at], lists[2][i][at], depth + at + 1))
            path[-1].add(conv, n, children, leaves, saved)
            path[-1].ends = path[-1].ends or ends
        yield _swept(out)
        out = []
    while path:
        close()
    yield _swept(out)


_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 5, pa.string()]
_NAMES = [part.strip().split(" ")[0] for part in SWEPT.split(",")]


def _swept(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_KINDS)], names=_NAMES)


def _grow(rows: DataFrame, depth: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Nodes below the heads of ``rows`` and a total per head, by bursting, sweeping and adding up.

    ``rows``: (head, suffix, conv, n, children, leaves, saved, ends).
    """
    totals = [c.split(" ")[0] for c in TOTAL.split(", ")]
    columns = ["head", "depth", "suffix", *totals]
    moving = materialize(rows.withColumn("depth", F.lit(depth).cast("bigint")).select(*columns))
    limit = max(limit, moving.count() // MAX_BURST)
    still, bursts = [], []
    while True:
        large = materialize(moving.groupBy("head").count().filter(F.col("count") > limit).select("head"))
        if large.isEmpty():
            still.append(moving)
            break
        still.append(moving.join(F.broadcast(large), "head", "left_anti"))
        burst = moving.join(F.broadcast(large), "head", "left_semi")
        first = F.col("suffix")[0]
        moved = materialize(
            burst.filter(F.size("suffix") > 0)
            .withColumns({"parent": F.col("head"), "length": first["n"], "depth": F.col("depth") + 1})
            .withColumn("head", F.md5(F.concat_ws(" ", "head", first["a"].cast("string"), first["b"].cast("string"))))
            .withColumn("suffix", F.slice("suffix", F.lit(2), F.size("suffix")))
        )
        ended = materialize(burst.filter(F.size("suffix") == 0).select("head", *totals))
        edges = moved.groupBy("head").agg(F.any_value("parent").alias("parent"), F.any_value("length").alias("length"))
        bursts.append((materialize(edges), ended))
        moving = moved.select(*columns)
    ready = still[0]
    for more in still[1:]:
        ready = ready.unionByName(more)
    turn = [F.col(f"suffix.{f}").alias(name) for f, name in (("a", "a"), ("b", "b"), ("n", "len"))]
    swept = materialize(
        ready.repartition("head").sortWithinPartitions("head", "suffix").select("head", "depth", *turn, *totals).mapInArrow(_sweep, SWEPT)
    )
    nodes = swept.filter(~F.col("total")).select("depth", "parent_conv", *totals)
    heads = swept.filter("total").select("head", "depth", *totals)
    for edges, ended in reversed(bursts):
        children = heads.join(edges, "head").withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("length"))
        children = materialize(children)
        at_head = [F.min("conv").alias("conv"), F.sum("n").alias("n"), F.sum("children").alias("children"),
                   F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("ends").alias("ends")]
        below = children.select(
            F.col("parent").alias("head"), (F.col("depth") - 1).alias("depth"), "conv", "n",
            F.lit(1).cast("bigint").alias("children"), "leaves", "saved", F.lit(None).cast("string").alias("ends"),
        )
        added = ended.withColumn("depth", F.lit(None).cast("bigint")).select(*below.columns)
        parents = materialize(below.unionByName(added).groupBy("head").agg(F.max("depth").alias("depth"), *at_head))
        # Burst heads are at most MAX_BURST a round.
        known = F.broadcast(parents.select(F.col("head").alias("parent"), F.col("conv").alias("parent_conv")))
        nodes = nodes.unionByName(children.join(known, "parent").select("depth", "parent_conv", *totals))
        heads = heads.join(edges.select("head"), "head", "left_anti").unionByName(parents.select("head", "depth", *totals))
    return nodes, heads


def prefix_trie(turns: DataFrame, limit: int = LIMIT, piece: int = PIECE) -> DataFrame:
    """Nodes of the trie of rebuilt conversations: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``,
    ``ends_sha256``.

    ``turns``: conv_id (whole numbers), turn, role, text; other columns are not read. Turns of one
    number are ordered by role and text, repeated rows are turns of their own. An empty table gives
    no node. Conversations of over ``piece`` turns cost one more round per ``piece`` turns.
    """
    rows = turns.select("conv_id", "turn", "role", "text")
    return trie_of(materialize(rebuild(materialize(rank_turns(rows)))), limit, piece)


def trie_of(rows: DataFrame, limit: int = LIMIT, piece: int = PIECE) -> DataFrame:
    """The trie of any sequences (conv, pos, a, b, n, size), as :func:`rebuild` gives them."""
    pieces = materialize(_pieces(rows, piece))
    deepest = pieces.agg(F.max("k")).first()[0]
    zero = F.lit(0).cast("bigint")
    ends = materialize(_ends(pieces.filter("last")))
    nodes, heads = [], None
    for k in range(deepest or 0, -1, -1):
        rows = ends.filter(F.col("k") == k).select(
            "head", F.col("turns").alias("suffix"), "conv", "n", zero.alias("children"), zero.alias("leaves"), zero.alias("saved"), "ends"
        )
        if heads is not None:
            links = pieces.filter((F.col("k") == k) & ~F.col("last")).groupBy("next").agg(
                F.any_value("head").alias("_head"), F.any_value("turns").alias("suffix")
            )
            found = links.join(heads, F.col("next") == F.col("head")).select(
                F.col("_head").alias("head"), "suffix", "conv", "n", "children", "leaves", "saved", "ends"
            )
            rows = rows.unionByName(found)
        below, heads = _grow(rows, k * piece, limit)
        nodes.append(below)
    top = heads.select("depth", F.lit(None).cast("bigint").alias("parent_conv"), "conv", "n", "children", "leaves", "saved", "ends")
    for below in nodes:
        top = top.unionByName(below)
    return top.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
