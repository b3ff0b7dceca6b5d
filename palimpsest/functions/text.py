"""Text rules as column expressions: Unicode white space, sentence ends, tokens, phonetic keys, places of substrings."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.isspace() has it, for a character class.
WS = r"\s\x0b\p{Z}\x1c-\x1f\x85"
# fixed values
TERMINALS = ".!?。！？"
CLOSERS = "\"')”’"
OPENERS = "\"'(“‘"
CODES = {"1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WS}]+", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"[{WS}]+\\z", "")


def strip(text: Column) -> Column:
    return rstrip(lstrip(text))


def is_blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{WS}]")


def ends_terminal(text: Column) -> Column:
    """A sentence end, closing quotes and white space behind it aside."""
    return F.coalesce(text, F.lit("")).rlike(f"[{TERMINALS}][{CLOSERS}]*[{WS}]*\\z")


def starts_upper(text: Column) -> Column:
    """The first character is an upper-case letter, opening quotes and then white space before it aside."""
    return F.coalesce(text, F.lit("")).rlike(f"^[{OPENERS}]*[{WS}]*\\p{{Lu}}")


def starts_letter(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"^[{WS}]*\\p{{L}}")


def normal_words(text: Column) -> Column:
    """Lower-case runs of letters and letter-like numbers, joined by one space."""
    return F.array_join(word_list(text), " ")


def word_list(text: Column) -> Column:
    """The words of normal_words() as an array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{Nl}\p{No}]+"), 0)


def normal_token(token: Column) -> Column:
    """Lower case, letters and numbers only."""
    return F.regexp_replace(F.lower(F.coalesce(token, F.lit(""))), r"[^\p{L}\p{N}]", "")


def edit_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """Unit-cost edits between code points; null is empty. With `most`, -1 stands for anything above it."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.levenshtein(a, b) if most is None else F.levenshtein(a, b, most)


def phonetic_key(word: Column) -> Column:
    """The first letter and up to three classes of consonants behind it, filled with zeros; '' without a letter.

    A class equal to the one directly before it is dropped; any letter without a class, h and w too, ends a run.
    """
    letters = F.regexp_replace(F.lower(F.coalesce(word, F.lit(""))), r"[^\p{L}]", "")
    coded = F.regexp_replace(F.translate(letters, "".join(CODES.values()), "".join(k * len(v) for k, v in CODES.items())), "[^1-6]", "0")
    tail = F.replace(F.substring(F.regexp_replace(coded, r"([0-9])\1+", "$1"), F.lit(2), F.length(coded)), F.lit("0"), F.lit(""))
    return F.when(letters == "", "").otherwise(F.substring(F.concat(F.substring(letters, 1, 1), tail, F.lit("000")), 1, 4))


def word_spans(text: Column) -> Column:
    """Array of (char_start, char_end, word), in order: runs of what is not white space, with code-point offsets [start, end). In Arrow batches, without an object for each word's row."""
    kind = "array<struct<char_start: int, char_end: int, word: string>>"
    # as if it were random: a filter on it would else be pushed below, and every text be split twice
    return F.arrow_udf(_words_of, kind).asNondeterministic()(F.coalesce(text, F.lit("")))


def _words_of(texts: pa.Array) -> pa.Array:
    offsets, starts, ends, words = word_table(texts.to_pylist())
    each = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(words, pa.string())], ["char_start", "char_end", "word"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each)


def word_table(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Words of all texts one after another: where each text's begin (and the end of the last), their starts and ends within the text, and the words."""
    words: list[str] = []
    counts, starts = [], []
    for t in texts:
        own = (t or "").split()
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        at = np.cumsum(sizes + 1) - sizes - 1
        if own and at[-1] + sizes[-1] != len(t):  # not one space between words each
            at, end = [], 0
            for w in own:
                at.append(t.index(w, end))
                end = at[-1] + len(w)
        words += own
        counts.append(len(own))
        starts.append(np.asarray(at, np.int64))
    first = np.concatenate([*starts, np.zeros(0, np.int64)])
    return np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))]).astype(np.int64), first, first + np.fromiter(map(len, words), np.int64, len(words)), words


def first_word(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), f"[^{WS}]+", 0)


def last_word(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), f"([^{WS}]+)[{WS}]*\\z", 1)


def places(text: Column, part: Column) -> Column:
    """All starts (from 0, overlapping ones too) of `part` in `text`; none of an empty part."""
    last = F.length(text) - F.length(part)
    found = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(text, i + 1, F.length(part)) == part)
    return F.when((F.length(part) > 0) & (last >= 0), found).otherwise(F.expr("CAST(array() AS array<int>)"))


def reanchor(text: Column, part: Column, start: Column, end: Column) -> Column:
    """Struct (char_start, char_end) of a snapshot in a text that may have changed; null where it no longer stands.

    The recorded offsets if they still hold, else the place nearest to the recorded start (the earliest of equally near ones, and
    the earliest of all where the start is null or negative).
    """
    return F.arrow_udf(_reanchored, "struct<char_start: int, char_end: int>").asNondeterministic()(F.coalesce(text, F.lit("")), part, start, end)


def _reanchored(texts: pa.Array, parts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    rows = zip(texts.to_pylist(), parts.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True)
    at = [(_nearest(*row), row[1]) for row in rows]
    return pa.array([None if i is None else {"char_start": i, "char_end": i + len(p)} for i, p in at], pa.struct([("char_start", pa.int32()), ("char_end", pa.int32())]))


def _nearest(text: str, part: str | None, start: int | None, end: int | None) -> int | None:
    """Where reanchor() finds a snapshot. Both searches are linear in the text; that to the left runs on reversed strings, since rfind is not."""
    if not part:
        return None
    if start is None or start < 0:
        at = text.find(part)
        return None if at < 0 else at
    if end is not None and end > start and text[start:end] == part:
        return start
    right = text.find(part, start)
    before = text[: start - 1 + len(part)] if start else ""
    left = before[::-1].find(part[::-1])
    left = len(before) - len(part) - left if left >= 0 else -1
    return None if left < 0 and right < 0 else right if left < 0 or 0 <= right and right - start < start - left else left
