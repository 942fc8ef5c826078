"""Word lookups: tokens to ids, to vectors, and to bag-of-vectors sentence encodings.

Vocabularies are bounded by construction (``num_words``), sentences are not. So the word table
goes to every executor, behind a check of its size, and the sentences stay where they are: no
shuffle. The lookup runs on Arrow columns, one hash lookup per distinct word of a batch. A
table over the limit is joined instead (salted against frequent words) and the tokens are put
together again by row key.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentloom import EOS_ID, UNK, UNK_ID
from sentloom.operators.joins import salted_join
from sentloom.operators.pooling import vector_sums
from sentloom.session import materialize

# Every Python worker holds its own copy of a broadcast word table.
MAX_BROADCAST_BYTES = 128 << 20
# Vectors gathered at once.
SLICE_BYTES = 32 << 20
# Vectors of the words of a block of sentences.
BLOCK_BYTES = 64 << 20
# Words of a sentence that are added together with those of the other sentences.
LONG_SENTENCE = 256
NO_UNK = f"oov='unk' needs a vector for {UNK}"


def _check_oov(oov: str) -> None:
    if oov not in ("unk", "drop"):
        raise ValueError(f"oov must be 'unk' or 'drop', not {oov!r}")


def table_bytes(table: DataFrame) -> int:
    """About the memory of a (word, id[, v]) table in a task."""
    size = F.octet_length("word") + 64
    if "v" in table.columns:
        size = size + F.size("v") * 8
    return table.agg(F.sum(size.cast("bigint")).alias("bytes")).first()["bytes"] or 0


def fits(table: DataFrame, max_bytes: int) -> bool:
    """Whether a (word, id[, v]) table is small enough to send to every executor."""
    return table_bytes(table) <= max_bytes


def _starts(lists: pa.ListArray) -> np.ndarray:
    """Offsets from 0 of a possibly sliced list array; NULL counts as empty."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)])


def _known(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Offsets and words of a list array; NULL words are left out, as in the join."""
    starts, words = _starts(lists), lists.flatten()
    if words.null_count:
        valid = words.is_valid().to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(valid)])[starts]
        words = words.drop_null()
    return starts, words


def _keyed(df: DataFrame, key: list[str] | None) -> tuple[DataFrame, list[str]]:
    """``df`` and its row key; without one, the rows are numbered and stored."""
    if key:
        return df, key
    return materialize(df.withColumn("_row_key", F.monotonically_increasing_id())), ["_row_key"]


def _join_back(df: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Rows meet what was found for their key; a NULL in a key is a value like others. Numbers given by
    :func:`_keyed` are never NULL; an equi-join keeps what was found, which can be wide, where its group
    by the key left it."""
    if key == ["_row_key"]:
        return df.join(found, key).drop("_row_key")
    renamed = found.withColumnsRenamed({k: f"_found_{k}" for k in key})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_found_{k}")) for k in key])
    return df.join(renamed, same).drop(*[f"_found_{k}" for k in key], "_row_key")


def _vector_type(word_vec: DataFrame) -> T.DataType:
    """The type of the vectors' elements: what goes in comes out."""
    kind = word_vec.schema["v"].dataType.elementType
    return kind if isinstance(kind, T.FloatType) else T.DoubleType()


def _lookup(words: pa.Array, places: dict, missing: int) -> np.ndarray:
    """Place of each word, by one dictionary lookup per distinct word."""
    coded = words.dictionary_encode()
    per_word = np.array(
        [places.get(w, missing) for w in coded.dictionary.to_pylist()], dtype=np.int32
    )
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return per_word[codes] if len(codes) else np.zeros(0, np.int32)


def _list_array(starts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), values)


def id_encoder(vocab: DataFrame, oov: str, nested: bool = False):
    """A column function tokens → ids over a broadcast vocabulary.

    With ``nested`` the column is an array of token arrays (all sentences of a file in a row).
    The caller has checked the size with :func:`fits`.
    """
    _check_oov(oov)
    rows = vocab.select("word", "id").toArrow()
    places = dict(zip(rows["word"].to_pylist(), rows["id"].to_pylist(), strict=True))
    shared = vocab.sparkSession.sparkContext.broadcast(places)

    def encode_lists(tokens: pa.Array) -> pa.Array:
        starts, words = _known(tokens)
        ids = _lookup(words, shared.value, UNK_ID if oov == "unk" else -1)
        if oov == "drop":
            known = ids >= 0
            starts = np.concatenate([[0], np.cumsum(known)])[starts]
            ids = ids[known]
        return _list_array(starts, pa.array(ids, pa.int32()))

    if nested:

        def encode(tokens: pa.Array) -> pa.Array:
            return _list_array(_starts(tokens), encode_lists(tokens.flatten()))

        return F.arrow_udf(encode, T.ArrayType(T.ArrayType(T.IntegerType())))

    def encode(tokens: pa.Array) -> pa.Array:
        return encode_lists(tokens)

    return F.arrow_udf(encode, T.ArrayType(T.IntegerType()))


def append_eos(ids: Column) -> Column:
    return F.concat(ids, F.array(F.lit(EOS_ID)))


def encode_ids(
    df: DataFrame,
    vocab: DataFrame,
    oov: str = "unk",
    tokens: str | list[str] = "tokens",
    out: str | list[str] = "ids",
    add_eos: bool = False,
    key: list[str] | None = None,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Token arrays → id arrays.

    ``oov="unk"``: unknown words become the unknown id. ``oov="drop"``: they vanish, and the
    end-of-sentence id is appended if asked; a sentence without known words stays, empty.
    NULL tokens are left out. ``vocab`` should be a stored table. ``key`` (unique row key) spares a
    vocabulary over ``max_bytes`` the numbering of the rows; the result is the same.
    """
    _check_oov(oov)
    tokens = [tokens] if isinstance(tokens, str) else tokens
    out = [out] if isinstance(out, str) else out
    add_eos = add_eos and oov == "drop"
    if fits(vocab, max_bytes):
        encode = id_encoder(vocab, oov)
        done = df.withColumns({o: encode(F.col(t)) for t, o in zip(tokens, out, strict=True)})
    else:
        done = df
        for t, o in zip(tokens, out, strict=True):
            done = _encode_by_join(done, vocab, oov, t, o, key)
    if add_eos:
        done = done.withColumns({o: append_eos(F.col(o)) for o in out})
    return done


def _encode_by_join(
    df: DataFrame, vocab: DataFrame, oov: str, tokens: str, out: str, key: list[str] | None
) -> DataFrame:
    df, key = _keyed(df, key)
    words = df.select(*key, F.posexplode_outer(tokens).alias("_i", "word"))
    found = salted_join(words, vocab.select("word", "id"), "word", [*key, "_i"], "left")
    if oov == "unk":
        value = F.when(F.col("word").isNotNull(), F.coalesce("id", F.lit(UNK_ID)))
    else:
        value = F.col("id")
    ids = (
        found.groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.struct("_i", value.alias("_id")))).alias("_s"))
        .select(
            *key,
            F.filter(F.transform("_s", lambda s: s["_id"]), lambda x: x.isNotNull()).alias(out),
        )
    )
    return _join_back(df, ids, key)


def _matrix(word_vec: DataFrame, oov: str) -> tuple[dict, np.ndarray]:
    """(word → row, matrix); the last row stands for unknown words."""
    rows = word_vec.select("word", "v").toArrow()
    words = rows["word"].to_pylist()
    flat = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    dim = len(flat) // max(len(words), 1)
    single = isinstance(_vector_type(word_vec), T.FloatType)
    matrix = np.zeros((len(words) + 1, dim), np.float32 if single else np.float64)
    matrix[:-1] = flat.reshape(len(words), dim)
    places = {w: i for i, w in enumerate(words)}
    if oov == "unk":
        if UNK not in places:
            raise ValueError(NO_UNK)
        matrix[-1] = matrix[places[UNK]]
    return places, matrix


def shared_matrix(word_vec: DataFrame, oov: str):
    """The word matrix as a broadcast variable; the caller has checked its size."""
    _check_oov(oov)
    return word_vec.sparkSession.sparkContext.broadcast(_matrix(word_vec, oov))


def _segments(starts: np.ndarray, max_words: int):
    """Runs of rows with about ``max_words`` words, to bound the gathered matrix."""
    first = 0
    while first < len(starts) - 1:
        last = int(np.searchsorted(starts, starts[first] + max_words, "right")) - 1
        last = min(max(last, first + 1), len(starts) - 1)
        yield first, last
        first = last


def bag_sums(rows: np.ndarray, starts: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Sum of the matrix rows of each sentence, some sentences at a time.

    The i-th words of all sentences that have one are added at once; the few words beyond
    ``LONG_SENTENCE`` sentence by sentence. Both add in the order of the words.
    """
    dim = matrix.shape[1]
    sums = np.zeros((len(starts) - 1, dim))
    step = max(1, (1 << 18) // max(dim, 1))
    for first in range(0, len(sums), step):
        begin = starts[first : first + step + 1]
        sizes = np.diff(begin)
        order = np.argsort(-sizes, kind="stable")
        begin, sizes = begin[order], sizes[order]
        total = np.zeros((len(order), dim))
        for i in range(min(int(sizes[0]), LONG_SENTENCE)):
            n = int(np.searchsorted(-sizes, -i, "left"))
            total[:n] += matrix[rows[begin[:n] + i]]
        for place in range(int(np.searchsorted(-sizes, -LONG_SENTENCE, "left"))):
            for at in range(int(begin[place]) + LONG_SENTENCE, int(begin[place] + sizes[place]), step):
                words = matrix[rows[at : min(at + step, int(begin[place] + sizes[place]))]].astype(np.float64)
                words[0] += total[place]
                total[place] = np.add.reduce(words, axis=0)
        sums[first + order] = total
    return sums


def _bag_encoder(shared):
    def encode(tokens: pa.Array) -> pa.Array:
        places, matrix = shared.value
        starts, known = _known(tokens)
        sums = bag_sums(_lookup(known, places, len(matrix) - 1), starts, matrix)
        offsets = np.arange(len(tokens) + 1) * matrix.shape[1]
        return _list_array(offsets, pa.array(sums.ravel()))

    return F.arrow_udf(encode, T.ArrayType(T.DoubleType()))


def joint_index(tables: list[tuple[DataFrame, str]]) -> tuple[dict, np.ndarray, list[np.ndarray]]:
    """Several (word table, mode) as one: word → row of a table that has, per model, the row of that
    model's matrix. The last row of each stands for unknown words. The caller has checked the sum of
    the sizes with :func:`table_bytes`."""
    found = [_matrix(table, oov) for table, oov in tables]
    words = dict.fromkeys(word for places, _ in found for word in places)
    index = {word: i for i, word in enumerate(words)}
    missing = [len(matrix) - 1 for _, matrix in found]
    rows = [[places.get(word, last) for (places, _), last in zip(found, missing, strict=True)] for word in index]
    return index, np.array([*rows, missing], np.int32), [matrix for _, matrix in found]


def encode_bow(
    df: DataFrame,
    word_vec: DataFrame,
    oov: str = "drop",
    tokens: str = "tokens",
    out: str = "v",
    key: list[str] | None = None,
    max_bytes: int = MAX_BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Bag of vectors: the sum of the word vectors; a zero vector for an empty sentence.

    Unknown words count as the vector of the unknown word (``unk``) or not at all (``drop``). A table
    over ``max_bytes`` meets blocks of sentences whose words' vectors take ``block_bytes``; rows of
    one ``key`` then count together.
    """
    _check_oov(oov)
    if fits(word_vec, max_bytes):
        return df.withColumn(out, _bag_encoder(shared_matrix(word_vec, oov))(F.col(tokens)))
    df, key = _keyed(df, key)
    dim = word_vec.select(F.size("v").alias("n")).first()["n"]
    zeros = F.array_repeat(F.lit(0.0), dim)
    rows, found = _bags_by_block(df, word_vec, oov, tokens, block_bytes)
    bag = F.to_json(F.struct(*key))
    again = rows.groupBy(F.xxhash64(bag)).count().filter("count > 1")
    if again.isEmpty():
        kept = [F.col(f"`{c}`") for c in df.columns if c not in ("_row_key", tokens, out)]
        words = [F.col("_tokens").alias(tokens)] if tokens != out else []
        coded = found.select(*kept, *words, F.coalesce("_v", zeros).alias(out))
        return coded.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("_row_key", out)], out)
    sums = vector_sums(found.select(bag.alias("_bag"), F.col("_v").alias("v")), "_bag", "v")
    return (
        df.withColumn("_row_bag", bag)
        .join(sums.select("_bag", F.col("total").alias(out)), F.col("_row_bag") == F.col("_bag"), "left")
        .withColumn(out, F.coalesce(F.col(out), zeros)).drop("_row_bag", "_bag", "_row_key")
    )


def _pieces(batch: pa.RecordBatch, max_words: int):
    """Runs of a batch's rows with about ``max_words`` words in the last column; a longer row is cut
    into several rows."""
    starts = _starts(batch.columns[-1])
    for first, last in _segments(starts, max_words):
        piece, size = batch.slice(first, last - first), int(starts[last] - starts[first])
        if size <= max_words:
            yield piece
            continue
        words = piece.columns[-1].flatten()
        for at in range(0, size, max_words):
            part = words.slice(at, max_words)
            yield pa.RecordBatch.from_arrays(
                [*piece.columns[:-1], _list_array(np.array([0, len(part)]), part)], names=batch.schema.names
            )


def _in_blocks(width: int, block_bytes: int):
    """Arrow batches with the tokens last → the same rows with word numbers for tokens, with ``_block``, a
    run of a task's rows, and on a block's first row ``_words``, its different words in the order of
    their numbers. Neither the rows of a block, the vectors of its words nor its sums, ``width`` bytes
    each, go far over ``block_bytes``."""
    most = max(4, block_bytes // max(width, 1))

    def coded(piece: pa.RecordBatch, words: dict) -> list[pa.Array]:
        lists = piece.columns[-1]
        found = lists.flatten().dictionary_encode()
        numbers = pa.array([words.setdefault(w, len(words)) for w in found.dictionary.to_pylist()], pa.int32())
        codes = pa.ListArray.from_arrays(pa.array(_starts(lists), pa.int32()), numbers.take(found.indices), mask=lists.is_null())
        return [*piece.columns[:-1], codes]

    def out(held: list, words: dict, block: int, names: list[str]):
        for i, columns in enumerate(held):
            size, asked = len(columns[-1]), [] if i else [list(words)]
            asked = pa.array(asked + [None] * (size - len(asked)), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(size, block)), asked], names=[*names, "_block", "_words"])

    def run(batches):
        block = TaskContext.get().partitionId() << 33
        held, words, size, rows, names = [], {}, 0, 0, []
        for batch in batches:
            names = batch.schema.names
            for piece in _pieces(batch, most // 4):
                held.append(coded(piece, words))
                size, rows = size + sum(c.nbytes for c in held[-1]), rows + len(piece)
                if len(words) + most // 4 > most or rows >= most or size >= block_bytes:
                    yield from out(held, words, block, names)
                    held, words, size, rows, block = [], {}, 0, 0, block + 1
        if held:
            yield from out(held, words, block, names)

    return run


def _bags_by_block(
    df: DataFrame, word_vec: DataFrame, oov: str, tokens: str, block_bytes: int
) -> tuple[DataFrame, DataFrame]:
    """Stored rows of ``df`` in blocks, and the same with ``_tokens`` and ``_v``, the sum of their words'
    vectors; NULL without words. A block asks once for each of its words, so what moves is the rows
    and a vector per different word of a block, never one per token. Very long rows come in parts."""
    wide = word_vec.agg(F.max(F.size("v"))).first()[0] or 0
    kept = [f for f in df.schema.fields if f.name != tokens]
    names = [f.name for f in kept]
    extra = "_codes array<int>, _block bigint, _words array<string>"
    plain = df.select(*[F.col(f"`{name}`") for name in names], F.col(tokens).alias("_codes"))
    schema = T.StructType([*kept, *T.StructType.fromDDL(extra).fields])
    rows = materialize(plain.mapInArrow(_in_blocks(wide * 8, block_bytes), schema))
    asks = rows.filter(F.col("_words").isNotNull()).select(
        F.col("_block").alias("_asked"), F.posexplode("_words").alias("_place", "word")
    )
    value = F.coalesce("v", _unknown_vector(word_vec)) if oov == "unk" else F.col("v")
    vectors = asks.join(word_vec.select("word", "v"), "word", "left").select(
        "_asked", "_place", "word", value.cast(T.ArrayType(_vector_type(word_vec))).alias("v")
    )

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        place, found = right["_place"].to_numpy(), right["v"].combine_chunks()
        numbers, first = np.unique(place, return_index=True)
        matrix = np.zeros((len(numbers), wide))
        flat = found.flatten().to_numpy(zero_copy_only=False)
        if len(flat):
            # A word with several vectors counts with all of them.
            own = place[found.is_valid().to_numpy(zero_copy_only=False)]
            np.add.at(matrix, own, flat.reshape(len(own), -1))
        codes = left["_codes"].combine_chunks()
        starts, known = _known(codes)
        sums = bag_sums(known.to_numpy(), starts, matrix)
        ends = pa.array(np.arange(len(left) + 1) * wide, pa.int32())
        lists = pa.ListArray.from_arrays(ends, pa.array(sums.ravel()), mask=pa.array(np.diff(starts) == 0))
        words = right["word"].combine_chunks().take(pa.array(first)).take(codes.flatten())
        texts = pa.ListArray.from_arrays(pa.array(_starts(codes), pa.int32()), words, mask=codes.is_null())
        return left.select(names).append_column("_tokens", texts).append_column("_v", lists)

    done = T.StructType([*kept, *T.StructType.fromDDL("_tokens array<string>, _v array<double>").fields])
    left = rows.drop("_words").groupBy("_block")
    return rows, left.cogroup(vectors.groupBy("_asked")).applyInArrow(add, done)


def _unknown_vector(word_vec: DataFrame) -> Column:
    if word_vec.filter(F.col("word") == UNK).isEmpty():
        raise ValueError(NO_UNK)
    return word_vec.filter(F.col("word") == UNK).select("v").scalar()


def _vectors_by_join(
    df: DataFrame, word_vec: DataFrame, oov: str, tokens: str, key: list[str]
) -> DataFrame:
    """(key, _i, word, _v) with the fallback vector of the mode in ``_v``."""
    words = df.select(*key, F.posexplode_outer(tokens).alias("_i", "word"))
    found = salted_join(words, word_vec.select("word", "v"), "word", [*key, "_i"], "left")
    kind = _vector_type(word_vec)
    if oov == "unk":
        fallback = _unknown_vector(word_vec)
    else:
        dim = word_vec.agg(F.max(F.size("v")).alias("n")).scalar()
        fallback = F.array_repeat(F.lit(0.0).cast(kind), dim)
    value = F.when(F.col("word").isNotNull(), F.coalesce("v", fallback))
    return found.select(*key, "_i", "word", value.cast(T.ArrayType(kind)).alias("_v"))


def _gathered(
    df: DataFrame, column: str, out: str, kind: T.DataType, slice_bytes: int, gather, width: int
) -> DataFrame:
    """``df`` with ``out``: ``gather(lists)`` of a list column. Vectors are gathered for a slice of the
    rows at a time, of about ``slice_bytes``, and each slice goes out as a batch of its own; so neither
    memory nor the 32-bit offsets of a list column depend on the length of the texts."""
    kept = [f for f in df.schema.fields if f.name.lower() != out.lower()]
    names = [f.name for f in kept]
    rows = df.select(*[F.col(f"`{name}`") for name in names], F.col(column).alias("_gathered"))

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            for first, last in _segments(_starts(lists), max(1, slice_bytes // max(width, 1))):
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], gather(part.columns[-1])], names=[*names, out]
                )

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField(out, kind)]))


def lookup_vectors(
    df: DataFrame,
    word_vec: DataFrame,
    oov: str = "drop",
    tokens: str = "tokens",
    out: str = "vectors",
    key: list[str] | None = None,
    max_bytes: int = MAX_BROADCAST_BYTES,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Tokens → sequence of word vectors, one per token, with the mode's fallback vector."""
    _check_oov(oov)
    if fits(word_vec, max_bytes):
        shared = shared_matrix(word_vec, oov)

        def gather(tokens: pa.Array) -> pa.Array:
            places, matrix = shared.value
            starts, known = _known(tokens)
            rows = _lookup(known, places, len(matrix) - 1)
            offsets = np.arange(len(rows) + 1) * matrix.shape[1]
            vectors = _list_array(offsets, pa.array(matrix[rows].ravel()))
            return _list_array(starts, vectors)

        kind = T.ArrayType(T.ArrayType(_vector_type(word_vec)))
        matrix = shared.value[1]
        return _gathered(df, tokens, out, kind, slice_bytes, gather, matrix.shape[1] * matrix.itemsize)
    df, key = _keyed(df, key)
    found = _vectors_by_join(df, word_vec, oov, tokens, key)
    seqs = found.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_s")
    )
    kind = T.ArrayType(T.ArrayType(_vector_type(word_vec)))
    vectors = F.filter(F.transform("_s", lambda s: s["_v"]), lambda v: v.isNotNull())
    return _join_back(df, seqs.select(*key, vectors.cast(kind).alias(out)), key)


def lookup_ids(
    df: DataFrame,
    table: DataFrame,
    ids: str = "ids",
    out: str = "vectors",
    max_bytes: int = MAX_BROADCAST_BYTES,
    key: list[str] | None = None,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Id arrays → sequences of vectors. ``table`` is (id, v); an unknown id gets zeros, a NULL id
    is left out."""
    by_text = table.select(F.col("id").cast("string").alias("word"), "v")
    if not fits(by_text, max_bytes):
        as_text = df.withColumn("_ids", F.transform(ids, lambda i: i.cast("string")))
        joined = lookup_vectors(as_text, by_text, "drop", "_ids", out, key, max_bytes)
        return joined.drop("_ids")
    rows = table.select("id", "v").toArrow()
    known = rows["id"].to_numpy()
    order = np.argsort(known, kind="stable")
    dtype = np.float32 if isinstance(_vector_type(table), T.FloatType) else np.float64
    flat = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    matrix = np.zeros((len(known) + 1, len(flat) // max(len(known), 1)), dtype)
    matrix[:-1] = flat.reshape(len(known), -1)[order] if len(known) else matrix[:-1]
    shared = df.sparkSession.sparkContext.broadcast((known[order], matrix))

    def gather(values: pa.Array) -> pa.Array:
        sorted_ids, vectors = shared.value
        starts, wanted = _known(values)
        wanted = wanted.to_numpy(zero_copy_only=False)
        places = np.searchsorted(sorted_ids, wanted)
        last = np.minimum(places, max(len(sorted_ids) - 1, 0))
        found = sorted_ids[last] == wanted if len(sorted_ids) else np.zeros(len(wanted), bool)
        gathered = vectors[np.where(found, places, len(sorted_ids))]
        offsets = np.arange(len(wanted) + 1) * vectors.shape[1]
        return _list_array(starts, _list_array(offsets, pa.array(gathered.ravel())))

    kind = T.ArrayType(T.ArrayType(_vector_type(table)))
    return _gathered(df, ids, out, kind, slice_bytes, gather, matrix.shape[1] * matrix.itemsize)
