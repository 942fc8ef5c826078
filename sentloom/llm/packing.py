"""Sequence packing: online sum-of-squares bin packing of tokenised documents.

Each task packs the documents of its partition as they come. The state is a level array: for
each fill level, the partially filled windows at it. A document's rest (what is left after its
full windows) goes to the level for which the sum of squared counts becomes least, so no level
gathers windows that nothing fits. At the end the emptiest windows are dissolved into what the
fullest still lack, their documents cut where need be, so at most one window of a task stays partly
empty. Small partitions are packed together: ``TASK_BYTES`` of text make some hundred windows, of
which that one is less than a hundredth.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentloom.llm.common import slices

TOKENIZER = "word_bpe_49k.json"
WINDOW = 4096
END_ID = 2
#: Partially filled windows at a time; beyond it the next document is cut to fill them.
MAX_OPEN = 512
#: Text of one task, at least.
TASK_BYTES = 2 << 20
#: Words in a worker's cache before it starts anew.
CACHE_WORDS = 1_000_000
#: Words encoded in one call.
LEARNT = 10_000
#: Sequence ids of a partition start at its number shifted by this.
SEQUENCE_BITS = 40
_PIECE = pa.schema(
    [
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("ids", pa.binary()),
    ]
)
_WORD_AND_MARKS = re.compile(rb"([^\x00-@\[-`{-\x7f]+)([!-&(-/:-@\[-`{-\x7f]+)?")


class WordTokenizer:
    """The tokenizer's ids as bytes (little-endian unsigned 32 bit), by a cache of words.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    parts between ASCII white space. A part that is letters and then punctuation is two words of
    the tokenizer. New words are encoded together in one call and told apart by their end marks.
    """

    def __init__(self, name: str) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for word, i in vocab.items() if word.endswith("</w>")]] = True
        self.cache: dict[bytes, bytes] = {}

    def whole(self, text: bytes) -> bytes:
        found = self.tokenizer.encode(text.decode(), add_special_tokens=False)
        return np.array(found.ids, "<u4").tobytes()

    def _learn_words(self, words: list[bytes]) -> None:
        found = self.tokenizer.encode(b" ".join(words).decode(), add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            self.cache.update((word, self.whole(word)) for word in words)
            return
        data, start = ids.tobytes(), 0
        for word, end in zip(words, (4 * ends).tolist(), strict=True):
            self.cache[word] = data[start:end]
            start = end

    def _learn(self, parts: set[bytes]) -> None:
        words, split = set(), []
        for part in parts:
            if part.isalpha():  # of bytes: ASCII letters only
                words.add(part)
                continue
            m = _WORD_AND_MARKS.fullmatch(part)
            # Lower-casing may turn a letter into a letter and a mark, which joins what follows.
            if not (m and (m[1].isalpha() or m[1].decode().lower().isalpha())):
                self.cache[part] = self.whole(part)
                continue
            if m[1] not in self.cache:
                words.add(m[1])
            if m[2]:
                split.append((part, m[1], m[2]))
        ordered = list(words)
        for at in range(0, len(ordered), LEARNT):
            self._learn_words(ordered[at : at + LEARNT])
        for part, word, marks in split:
            if marks not in self.cache:
                self.cache[marks] = self.whole(marks)
            self.cache[part] = self.cache[word] + self.cache[marks]

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """A document's ids per text, without the closing one. New words of all texts are learnt
        together."""
        parts = []
        for text in texts:
            low = text.lower()  # of bytes: A-Z only, which the tokenizer lower-cases too
            # "<|" may begin a special token, which has its case.
            parts.append(None if b"<|" in low else low.split())
        needed = set().union(*(p for p in parts if p))
        new = needed.difference(self.cache)
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = needed
        self._learn(new)
        get = self.cache.__getitem__
        for text, split in zip(texts, parts, strict=True):
            yield self.whole(text) if split is None else b"".join(map(get, split))


class SumOfSquaresPacker:
    """Packs (key, n tokens) as they come; calls ``emit(key, start, length, sequence, offset)`` for the
    pieces of a window once it is full, and of all windows at the end. ``rest(key, start)`` may
    give a smaller key for a document's piece from ``start`` on."""

    def __init__(self, emit, first_sequence: int, window: int = WINDOW, max_open: int = MAX_OPEN, rest=None):
        self.emit, self.window, self.max_open = emit, window, max_open
        self.rest = rest or (lambda key, start: key)
        self.next_sequence = first_sequence
        self.counts = np.zeros(window + 1, np.int64)
        #: Open windows by level; a window is the list of its pieces (key, start, length).
        self.open: dict[int, list[list[tuple]]] = {}
        self.n_open = 0

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, start, length in pieces:
            self.emit(key, start, length, self.next_sequence, offset)
            offset += length
        self.next_sequence += 1

    def _put(self, key, start: int, length: int, level: int) -> None:
        """A piece into a window at ``level`` (0: a new one)."""
        pieces: list[tuple] = []
        if level:
            pieces = self.open[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        pieces.append((key, start, length))
        level += length
        if level == self.window:
            self._close(pieces)
        else:
            self.open.setdefault(level, []).append(pieces)
            self.counts[level] += 1
            self.n_open += 1

    def level_for(self, length: int) -> int:
        """The level at which a piece raises the sum of squared counts least; the fuller one
        among equals."""
        levels = np.flatnonzero(self.counts[1 : self.window - length + 1]) + 1
        if not len(levels):
            return 0
        after = levels + length
        rise = 1 - 2 * self.counts[levels]
        rise += np.where(after < self.window, 2 * self.counts[after] + 1, 0)
        best = len(levels) - 1 - int(np.argmin(rise[::-1]))
        return int(levels[best]) if rise[best] <= 2 * self.counts[length] + 1 else 0

    def add(self, key, n: int) -> None:
        start = 0
        while n - start >= self.window:
            self._close([(key, start, self.window)])
            start += self.window
        if start:
            key = self.rest(key, start)
        if self.n_open <= self.max_open:
            if n > start:
                self._put(key, start, n - start, self.level_for(n - start))
            return
        while start < n:  # cut into what the fullest windows lack
            level = int(np.flatnonzero(self.counts)[-1])
            length = min(n - start, self.window - level)
            self._put(key, start, length, level)
            start += length

    def finish(self) -> None:
        """Dissolve the emptiest windows into the fullest."""
        left = [(level, pieces) for level in sorted(self.open) for pieces in self.open[level]]
        self.open, self.n_open = {}, 0
        self.counts[:] = 0
        low, high = 0, len(left) - 1
        while low < high:
            level, target = left[high]
            source = left[low][1]
            while source and level < self.window:
                key, start, length = source.pop()
                taken = min(length, self.window - level)
                target.append((key, start, taken))
                level += taken
                if taken < length:
                    source.append((key, start + taken, length - taken))
            left[high] = (level, target)
            high -= level == self.window
            low += not source
        for _, pieces in left:
            if pieces:
                self._close(pieces)


def pack_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = TOKENIZER,
    window: int = WINDOW,
    end_id: int = END_ID,
    max_open: int = MAX_OPEN,
    task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """Pieces of all documents in windows of ``window`` tokens: id, start, length, doc_tokens,
    sequence_id, offset and the piece's ids (binary, little-endian unsigned 32 bit).

    A document is its tokens and ``end_id``; a null or empty text is ``end_id`` alone. Every token
    is in exactly one piece. Rows with equal or null ids are documents of their own. Tasks
    pack their partitions independently, without a shuffle; a task run again packs the same. Partitions
    are joined to ``task_bytes`` of text, for which the texts' sizes are added up first.
    Memory: the tokens of ``max_open`` windows, beside the batch at hand.
    """
    kind = df.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind)]
        + [T.StructField(f.name, T.BinaryType() if f.name == "ids" else T.LongType()) for f in _PIECE]
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _tokenizer(tokenizer)
        rows: list[tuple] = []
        end = np.array([end_id], "<u4").tobytes()

        def emit(key, start, length, sequence, offset):
            doc, n, first, ids = key
            at = 4 * (start - first)
            rows.append((doc, start, length, n, sequence, offset, ids[at : at + 4 * length]))

        def rest(key, start):
            doc, n, first, ids = key
            return doc, n, start, ids[4 * (start - first) :]

        packer = SumOfSquaresPacker(
            emit, TaskContext.get().partitionId() << SEQUENCE_BITS, window, max_open, rest
        )
        arrow_id = None

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], arrow_id)]
                + [pa.array(c, f.type) for c, f in zip(columns[1:], _PIECE, strict=True)],
                names=["doc_id", *_PIECE.names],
            )

        for batch in batches:
            arrow_id = batch.column(0).type
            for part, texts in slices(batch, "text"):
                for doc, ids in zip(part.column(0).to_pylist(), words.encode(texts), strict=True):
                    n = len(ids) // 4 + 1
                    packer.add((doc, n, 0, ids + end), n)
                if rows:
                    yield out()
        packer.finish()
        if rows:
            yield out()

    texts = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    return texts.coalesce(max(1, size // task_bytes)).mapInArrow(packed, schema)


_LOADED: dict[str, WordTokenizer] = {}


def _tokenizer(name: str) -> WordTokenizer:
    """One per worker process: reading the vocabulary takes longer than a small task."""
    if name not in _LOADED:
        _LOADED[name] = WordTokenizer(name)
    return _LOADED[name]
