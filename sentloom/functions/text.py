"""Text scalars as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
# ASCII white space, as a plain byte-string split sees it.
WHITESPACE = r"[ \t\n\x0B\f\r]+"
OTHER_SPACES = "\t\n\x0B\f\r"
# The 32 ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Sentence boundary: closing punctuation followed by space, or line breaks.
SENTENCE_BREAK = r"[.!?]+\s+|\n+"
# A word (letters, marks, digits, inner apostrophes and hyphens) or one other visible character.
WORD = (
    r"[\p{L}\p{M}\p{N}]+(?:['’-][\p{L}\p{M}\p{N}]+)*"
    r"|[^\p{L}\p{M}\p{N}\s\x0B]"
)


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def split_sentences(col: Column | str) -> Column:
    """Text → array of sentences."""
    return F.split(_col(col), SENTENCE_BREAK)


def ws_tokens(col: Column | str) -> Column:
    """White-space tokens without empty ones. Where the only white space is the space, the text is split
    without a regular expression; the array of one text has ``col`` computed once for all its uses."""
    return F.get(F.transform(F.array(_col(col)), _ws_tokens), F.lit(0))


def _ws_tokens(text: Column) -> Column:
    other = reduce(or_, [text.contains(c) for c in OTHER_SPACES])
    words = F.when(other, F.split(text, WHITESPACE)).otherwise(F.split(text, F.lit(" ")))
    return F.filter(words, lambda word: word != "")


def space_tokens(col: Column | str) -> Column:
    """Single-space tokens; empty tokens stay."""
    return F.split(_col(col), " ", -1)


def lower_tokens(col: Column | str) -> Column:
    return F.transform(_col(col), F.lower)


def strip_punctuation(col: Column | str) -> Column:
    return F.translate(_col(col), PUNCTUATION, "")


def clean_caption(col: Column | str) -> Column:
    """Punctuation off, split, lower-case."""
    return ws_tokens(F.lower(strip_punctuation(col)))


def tokenize(col: Column | str) -> Column:
    """Raw text → lower-cased words and punctuation marks, over all sentences of the text."""
    return F.regexp_extract_all(F.lower(_col(col)), F.lit(WORD), 0)


def tagged_tokens(col: Column | str) -> Column:
    """``word/TAG`` tokens → ``word/TA``; other tokens are left out.

    A token counts when it has exactly one slash and the first two characters of the tag are
    ASCII letters.
    """
    kept = F.filter(
        ws_tokens(col), lambda t: t.rlike(r"^[^/]*/(?:[A-Za-z]$|[A-Za-z]{2}[^/]*$)")
    )
    return F.transform(
        kept,
        lambda t: F.concat_ws(
            "/",
            F.lower(F.substring_index(t, "/", 1)),
            F.substring(F.substring_index(t, "/", -1), 1, 2),
        ),
    )


def append_eos_word(tokens: Column | str, eos: str = "<eos>") -> Column:
    return F.array_append(_col(tokens), F.lit(eos))


def shorter_than(tokens: Column | str, max_len: int) -> Column:
    """Length rule: strictly fewer than ``max_len`` tokens; 0 turns it off."""
    return F.size(_col(tokens)) < max_len if max_len else F.lit(True)
