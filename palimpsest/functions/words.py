"""Word ranges of a text as spans of time, from the words of a forced alignment."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from difflib import SequenceMatcher
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from palimpsest.functions import text as T
from palimpsest.lineage import on_path

# fixed values
ALIGNED, PARTLY, ESTIMATED = "fa-word", "fa-partial", "estimated"
LEAST = 0.01
SNAP_SCHEMA = "start_s double, end_s double, snap string, words array<struct<s: double, e: double, text: string>>"


class Token(NamedTuple):
    char_start: int
    char_end: int
    word: str


class Snap(NamedTuple):
    start: float
    end: float
    snap: str
    words: list[dict]


def tokens_of(text: str | None) -> list[Token]:
    return [Token(m.start(), m.end(), m[0]) for m in re.finditer(r"\S+", text or "")]


def plain(word: str | None) -> str:
    return "".join(c for c in (word or "").lower() if c.isalnum())


def snap_span(text: str | None, first: int, last: int, start: float | None, end: float | None, aligned: list[dict] | None) -> Snap | None:
    """The span of words first..last of a text that lasts from `start` to `end`; None for no such words or no duration.

    Aligned words count that lie in the segment by over half. As many as the text has words pair up by place, others by matching blocks of normal forms.
    'fa-word': both end words are aligned. 'fa-partial': some are; a missing edge is extrapolated at the rate of the others, within the segment.
    'estimated': none; the edges follow the share of characters.
    """
    words = tokens_of(text)
    if start is None or end is None or not end > start or not 0 <= first <= last < len(words):
        return None
    inside = [w for w in aligned or () if w["e"] > w["s"] and min(w["e"], end) - max(w["s"], start) > (w["e"] - w["s"]) / 2]
    low, high, kind, a, b = _span(words, first, last, start, end, len(text or ""), [w["s"] for w in inside], [w["e"] for w in inside], lambda: [w["text"] for w in inside])
    return Snap(low, high, kind, inside[a:b])


def _span(words: list[Token], first: int, last: int, start: float, end: float, size: int, s: Sequence[float], e: Sequence[float], texts: Callable[[], list[str]]) -> tuple[float, float, str, int, int]:
    """snap_span() with the aligned words inside as their starts and ends; instead of those it gives the first and the end of their places."""
    if len(s) == len(words):
        met, partner = [first, last], {first: first, last: last}
    else:
        blocks = SequenceMatcher(None, [plain(w) for w in texts()], [plain(t.word) for t in words], autojunk=False).get_matching_blocks() if len(s) else []
        partner = {b.b + i: b.a + i for b in blocks for i in range(b.size)}
        met = [i for i in range(first, last + 1) if i in partner]
    if not met:
        share = (end - start) / max(1, size)
        low, high = start + share * words[first].char_start, start + share * words[last].char_end
        return low, max(high, low + LEAST), ESTIMATED, 0, 0
    a, b = partner[met[0]], partner[met[-1]]
    low, high = s[a], e[b]
    if met[0] == first and met[-1] == last:
        return low, high, ALIGNED, a, b + 1
    rate = (high - low) / max(1, words[met[-1]].char_end - words[met[0]].char_start)
    if met[0] != first:
        low = max(start, low - rate * (words[met[0]].char_start - words[first].char_start))
    if met[-1] != last:
        high = min(end, high + rate * (words[last].char_end - words[met[-1]].char_end))
    return low, max(high, low + LEAST), PARTLY, a, b + 1


def facing_bound(text: str | None, char_start: int, char_end: int, side: str, start: float | None, end: float | None, aligned: list[dict] | None) -> tuple[str, float] | None:
    """The word next to a character span ('next' or 'prev') and the aligned time of its facing edge; None unless it is aligned."""
    words = tokens_of(text)
    if side == "next":
        at = next((i for i, w in enumerate(words) if w.char_start >= char_end), None)
    else:
        at = next((i for i in reversed(range(len(words))) if words[i].char_end <= char_start), None) if side == "prev" else None
    got = None if at is None else snap_span(text, at, at, start, end, aligned)
    if got is None or got.snap != ALIGNED:
        return None
    return words[at].word, got.start if side == "next" else got.end


class _Words(Sequence):
    """The words of one text of a table of words; a Token is made where one is asked for."""

    def __init__(self, table: tuple, low: int, high: int) -> None:
        self.table, self.low, self.high = table, low, high

    def __len__(self) -> int:
        return self.high - self.low

    def __getitem__(self, i: int) -> Token:
        if not 0 <= i < len(self):
            raise IndexError(i)
        _, starts, ends, words = self.table
        return Token(int(starts[self.low + i]), int(ends[self.low + i]), words[self.low + i])


class _Batch:
    """Rows of one Arrow batch with the words of their texts and the aligned words that lie in each by over half, in flat arrays."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.texts = batch.column("text").to_pylist()
        self.table = T.word_table(self.texts)
        self.start, self.end = (batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("start_time", "end_time"))
        lists = batch.column("aligned")
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = pc.list_flatten(lists)
        s, e = (pc.struct_field(flat, n).to_numpy(zero_copy_only=False) for n in ("s", "e"))
        row = np.repeat(np.arange(len(counts)), counts)
        with np.errstate(invalid="ignore"):
            held = np.flatnonzero((e > s) & (np.minimum(e, self.end[row]) - np.maximum(s, self.start[row]) > (e - s) / 2))
        self.inside = flat.take(pa.array(held))
        self.s, self.e = s[held], e[held]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(row[held], minlength=len(counts)))]).astype(np.int64)

    def words(self, n: int) -> _Words:
        return _Words(self.table, int(self.table[0][n]), int(self.table[0][n + 1]))

    def span(self, n: int, first: int, last: int) -> tuple[float, float, str, int, int] | None:
        """snap_span() of row n, with places among all that lie inside."""
        words, start, end = self.words(n), float(self.start[n]), float(self.end[n])
        if not end > start or not 0 <= first <= last < len(words):
            return None
        low, high = int(self.at[n]), int(self.at[n + 1])
        texts = lambda: pc.struct_field(self.inside.slice(low, high - low), "text").to_pylist()
        s, e, kind, a, b = _span(words, first, last, start, end, len(self.texts[n] or ""), self.s[low:high], self.e[low:high], texts)
        return float(s), float(e), kind, low + a, low + b


def _arrow(df: DataFrame, rows: Callable[[pa.RecordBatch], list[pa.Array]], more: str) -> DataFrame:
    """`df` with columns that `rows` gives for each Arrow batch."""
    on_path(df.sparkSession)
    out = StructType([*df.schema.fields, *StructType.fromDDL(more).fields])
    schema = to_arrow_schema(out)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            made = [*batch.columns, *rows(batch)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, schema, strict=True)], schema=schema)

    return df.mapInArrow(run, out)


def snap_words(df: DataFrame) -> DataFrame:
    """`df` (text, first_word, last_word, start_time, end_time, aligned: array of (s, e, text)) with start_s, end_s, snap and words; nulls where refused."""

    def rows(batch: pa.RecordBatch) -> list[pa.Array]:
        b = _Batch(batch)
        got = [b.span(n, int(i), int(j)) for n, (i, j) in enumerate(zip(batch.column("first_word").to_pylist(), batch.column("last_word").to_pylist(), strict=True))]
        spans = [(0, 0) if g is None else g[3:] for g in got]
        sizes = np.array([j - i for i, j in spans], np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        firsts = np.array([i for i, _ in spans], np.int64)
        held = b.inside.take(pa.array(np.arange(ends[-1]) + np.repeat(firsts - ends[:-1], sizes)))
        mask = pa.array([g is None for g in got], pa.bool_())
        words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held, mask=mask)
        first = [pa.array([None if g is None else g[i] for g in got], kind) for i, kind in enumerate((pa.float64(), pa.float64(), pa.string()))]
        return [*first, words]

    return _arrow(df, rows, SNAP_SCHEMA)


def facing_bounds(df: DataFrame, side: str) -> DataFrame:
    """`df` (text, char_start, char_end, start_time, end_time, aligned) with neighbour_word and neighbour_time."""

    def rows(batch: pa.RecordBatch) -> list[pa.Array]:
        b = _Batch(batch)
        offsets, starts, ends, words = b.table
        found: list[tuple[str | None, float | None]] = []
        for n, (c, d) in enumerate(zip(batch.column("char_start").to_pylist(), batch.column("char_end").to_pylist(), strict=True)):
            low, high = int(offsets[n]), int(offsets[n + 1])
            at = int(np.searchsorted(starts[low:high], int(d))) if side == "next" else int(np.searchsorted(ends[low:high], int(c), "right")) - 1 if side == "prev" else -1
            got = b.span(n, at, at)
            found.append((None, None) if got is None or got[2] != ALIGNED else (words[low + at], got[0] if side == "next" else got[1]))
        return [pa.array([w for w, _ in found], pa.string()), pa.array([t for _, t in found], pa.float64())]

    return _arrow(df, rows, "neighbour_word string, neighbour_time double")


def estimated_span(first: str = "char_start", last: str = "char_end"):
    """The 'estimated' tier as expressions: a character range as a struct (start_s, end_s) of the segment's time."""
    n = F.greatest(F.lit(1), F.length(F.coalesce("text", F.lit(""))))
    share = (F.col("end_time") - F.col("start_time")) / n
    low = F.col("start_time") + share * F.col(first)
    return F.when(F.col("end_time") > F.col("start_time"), F.struct(low.alias("start_s"), F.greatest(F.col("start_time") + share * F.col(last), low + LEAST).alias("end_s")))
