"""Deterministic review signals of segments, and the worklist they make."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.lineage import on_path
from palimpsest.operators.ordering import bucket_of, scan

KEYS = ["source_id"]
# fixed values
NO_TERMINAL, NOT_UPPER = "boundary-missing-terminal", "boundary-terminal-then-lowercase"
EMPTY, UNTIMED, DIVERGES = "empty-text", "missing-timing", "transcriber-divergence"


def with_next(segments: DataFrame, columns: list[str], keys: list[str] = KEYS) -> DataFrame:
    """`segments` with next_<column> of the following one in the spine; next_id tells whether there is one."""
    follow = scan(segments, keys, ["idx", "id"], {"_next": ("next", F.struct("id", *columns))}, bucket_of("idx"))
    return follow.select(*segments.columns, *[F.col("_next")[c].alias(f"next_{c}") for c in ["id", *columns]])


def empty_positions(segments: DataFrame) -> DataFrame:
    return segments.where(T.is_blank(F.col("text")))


def coverage_flags(text="text", start="start_time", end="end_time"):
    """'empty-text' and 'missing-timing', in this order."""
    return F.array_compact(F.array(F.when(T.is_blank(F.col(text)), EMPTY), F.when(F.col(start).isNull() | F.col(end).isNull(), UNTIMED)))


def boundary_flags(text="text", following="next_text"):
    """What is odd between a text and the next one; both must have some."""
    left, right = F.col(text), F.col(following)
    return _odd(~T.is_blank(left) & ~T.is_blank(right), T.ends_terminal(left), T.starts_upper(right), T.starts_letter(right))


def _odd(both, ends, upper, letter):
    return F.array_compact(F.array(F.when(both & ~ends & upper, NO_TERMINAL), F.when(both & ends & letter & ~upper, NOT_UPPER)))


def divergence(segments: DataFrame, variants: DataFrame) -> DataFrame:
    """id, text, transcriber, variant_text: the first variant (by pos, then transcriber) of each segment with other words than the segment's text.

    `variants` has segment_id, transcriber, variant_text and may have pos.
    """
    pos = F.col("pos") if "pos" in variants.columns else F.lit(0)
    rows = variants.select("segment_id", "transcriber", "variant_text", pos.alias("pos"))
    other = segments.select("id", "text").join(rows, F.col("id") == F.col("segment_id")).where(T.normal_words(F.col("variant_text")) != T.normal_words(F.col("text")))
    first = other.groupBy("id").agg(F.min(F.struct("pos", "transcriber", "text", "variant_text")).alias("v"))
    return first.select("id", F.coalesce("v.text", F.lit("")).alias("text"), "v.transcriber", "v.variant_text")


def signal_flags(segments: DataFrame, variants: DataFrame | None = None, keys: list[str] = KEYS, diverging: DataFrame | None = None) -> DataFrame:
    """`segments` with flags: coverage, then boundary, then divergence, each once. `diverging` (id) are the rows of divergence(), where they are known already.

    What a boundary asks of the following text is told beside that text, so that no text goes to its neighbour.
    """
    text = F.col("text")
    told = F.struct(T.is_blank(text).alias("blank"), T.starts_upper(text).alias("upper"), T.starts_letter(text).alias("letter"))
    rows = scan(segments, keys, ["idx", "id"], {"_next": ("next", told)}, bucket_of("idx"))
    follows = lambda name: F.coalesce(F.col("_next")[name], F.lit(name == "blank"))
    flags = [coverage_flags(), _odd(~T.is_blank(text) & ~follows("blank"), T.ends_terminal(text), follows("upper"), follows("letter"))]
    if variants is not None and diverging is None:
        diverging = divergence(segments, variants)
    if diverging is not None:
        rows = rows.join(diverging.select("id", F.lit(True).alias("_diverges")), "id", "left")
        flags.append(F.array_compact(F.array(F.when(F.col("_diverges"), DIVERGES))))
    return rows.select(*segments.columns, F.array_distinct(F.concat(*flags)).alias("flags"))


def worklist(flagged: DataFrame, markers: DataFrame) -> DataFrame:
    """Flagged segments without a decision. `markers` has segment_id and decision; a null or empty decision is none."""
    done = markers.where("decision <> ''").select(F.col("segment_id").alias("_done"))
    return flagged.where(F.size("flags") > 0).join(done, F.col("id") == F.col("_done"), "left_anti")


def cluster_variants(words: DataFrame, word: str = "word", order: str = "pos", max_edits: int = 2) -> DataFrame:
    """cluster (the first member), pos (in its cluster), word: spellings that sound alike and lie within `max_edits` of the first of them.

    In the order of their first occurrence, stripped words join the first cluster with the same phonetic key whose first member is near in lower case, or
    open one; clusters of one are left out. Clusters never cross keys, so each key's distinct words are one task's work.
    """
    on_path(words.sparkSession)
    # the counts tie what is asked of a word to the words that are left: else these filters would go below the aggregation, to every place of a word
    once = lambda rows: rows.groupBy("word").agg(F.min("at").alias("at"), F.count("*").alias("n"))
    rows = once(words.select(F.col(word).alias("word"), F.col(order).alias("at"))).select(F.when(F.col("n") > 0, T.strip(F.col("word"))).alias("word"), "at")
    rows = once(rows.where("word <> ''")).withColumn("key", F.when(F.col("n") > 0, T.phonetic_key(F.col("word")))).where("key <> ''")

    def lead(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, leaders = None, _Leaders(max_edits)
        for part in it:
            out: list[tuple] = []
            for key, word in zip(part["key"], part["word"], strict=True):
                if key != now:
                    out += leaders.told()
                    now, leaders = key, _Leaders(max_edits)
                leaders.add(word)
            yield pd.DataFrame(out, columns=["cluster", "pos", "word"])
        yield pd.DataFrame(leaders.told(), columns=["cluster", "pos", "word"])

    return rows.repartition("key").sortWithinPartitions("key", "at", "word").select("key", "word").mapInPandas(lead, "cluster string, pos long, word string")


#: Longer words are compared one by one; what deletions leave of them would be too much.
SHORT = 24


class _Leaders:
    """Clusters of one phonetic key. What is left of short first members by deletions finds the near ones, so most pairs are never compared."""

    def __init__(self, most: int) -> None:
        self.most, self.clusters, self.near, self.long = most, [], {}, []

    def add(self, word: str) -> None:
        own = word.lower()
        cuts = _deletions(own, self.most) if len(own) <= SHORT else set()
        home = {c for x in cuts for c in self.near.get(x, ())}
        if len(own) + self.most > SHORT:
            home.update(self.long)
        for c in sorted(home):
            if _within(self.clusters[c][0].lower(), own, self.most):
                self.clusters[c].append(word)
                return
        for x in cuts:
            self.near.setdefault(x, []).append(len(self.clusters))
        if len(own) + self.most > SHORT:
            self.long.append(len(self.clusters))
        self.clusters.append([word])

    def told(self) -> list[tuple]:
        return [(c[0], i, w) for c in self.clusters if len(c) > 1 for i, w in enumerate(c)]


def _deletions(word: str, most: int) -> set[str]:
    """What up to `most` deletions leave. Words within `most` edits share some of it, so it finds all that are near."""
    out = last = {word}
    for _ in range(most):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        out = out | last
    return out


def _within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most `most`, by a band around the diagonal."""
    if abs(len(a) - len(b)) > most:
        return False
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        now: dict[int, int] = {}
        for j in _band(i, most, len(b)):
            costs = [row[j - 1] + (x != b[j - 1])] if j and j - 1 in row else []
            costs += [row[j] + 1] if j in row else []
            costs += [now[j - 1] + 1] if j - 1 in now else []
            now[j] = min(costs)
        if min(now.values()) > most:
            return False
        row = now
    return row[len(b)] <= most


def _band(i: int, most: int, n: int) -> Iterator[int]:
    yield from range(max(0, i - most), min(n, i + most) + 1)
