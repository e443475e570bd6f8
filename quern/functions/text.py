"""Text functions on string columns: tokenizers, byte codecs, n-grams. All stay in the JVM."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = string.punctuation
#: Frequent English function words; another list can be given wherever stop words are dropped.
STOP_WORDS = tuple(
    "a about above after again all also am an and any are as at be been before being below between both but by can could did do does down each "
    "few for from further had has have he her here hers him his how i if in into is it its just me more most my no nor not now of off on once "
    "only or other our out over own same she should so some such than that the their them then there these they this those through to too "
    "under until up very was we were what when where which while who whom why will with would you your".split()
)
WORD = r"[\p{L}\p{N}_]{2,}"
WORD_OR_SIGN = r"[\p{L}\p{N}_]+|[^a-zA-Z0-9\s]"


def remove_stop_words(words: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Drops array elements whose lower case is a stop word."""
    return F.filter(words, lambda w: ~F.lower(w).isin(list(stop)))


def strip_punctuation(line: Column) -> Column:
    """Deletes ASCII punctuation, then white space at both ends."""
    return F.regexp_replace(F.translate(line, PUNCTUATION, ""), r"^\s+|\s+$", "")


def tokenize_whitespace(line: Column, lowercase: bool = True, stop: Sequence[str] | None = STOP_WORDS) -> Column:
    line = F.lower(line) if lowercase else line
    words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    return remove_stop_words(words, stop) if stop else words


def tokenize_words(line: Column, lowercase: bool = True, stop: Sequence[str] | None = STOP_WORDS, filter_punctuation: bool = True) -> Column:
    """Runs of two or more word characters; with punctuation kept, also single ones and signs."""
    line = F.lower(line) if lowercase else line
    words = F.regexp_extract_all(line, F.lit(WORD if filter_punctuation else WORD_OR_SIGN), F.lit(0))
    return remove_stop_words(words, stop) if stop else words


def utf8_bytes(s: Column) -> Column:
    """The UTF-8 bytes of a string as numbers."""
    pairs = F.filter(F.split(F.hex(F.encode(s, "UTF-8")), r"(?<=\G..)"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.conv(p, 16, 10).cast("int"))


def tokenize_words_bytes(line: Column, lowercase: bool = True, stop: Sequence[str] | None = STOP_WORDS, filter_punctuation: bool = True) -> Column:
    """Each word as its bytes in decimal, joined by spaces."""
    return F.transform(tokenize_words(line, lowercase, stop, filter_punctuation), lambda w: F.array_join(utf8_bytes(w).cast("array<string>"), " "))


def tokenize_bytes_raw(line: Column, split_punctuation: bool = False) -> Column:
    """The bytes of a line in decimal as one token; or split so that each punctuation byte is a token."""
    joined = F.array_join(utf8_bytes(line).cast("array<string>"), " ")
    if not split_punctuation:
        return F.array(joined)
    signs = "|".join(str(ord(c)) for c in PUNCTUATION)
    parts = F.split(F.regexp_replace(joined, rf"(?<!\S)({signs})(?!\S)", "-$1-"), "-")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def bytes_to_chars(numbers: Column) -> Column:
    """The string that an array of byte values encodes."""
    return F.decode(F.unhex(F.array_join(F.transform(numbers, lambda b: F.lpad(F.hex(b.cast("bigint")), 2, "0")), "")), "UTF-8")


def tokenize_chars(line: Column, lowercase: bool = True, filter_punctuation: bool = True) -> Column:
    line = F.lower(line) if lowercase else line
    line = strip_punctuation(line) if filter_punctuation else line
    return F.filter(F.split(F.regexp_replace(line, " {2,}", " "), ""), lambda c: c != "")


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n elements of an array; none where it is shorter."""
    count = F.size(tokens) - n + 1
    runs = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.slice(tokens, i, n))
    return F.when(count >= 1, runs).otherwise(F.array().cast("array<array<string>>"))
