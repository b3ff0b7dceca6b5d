"""Repeated runs of lines: winnowed fingerprints find them, extension gives their full length, later occurrences go.

A fingerprint is the hash of RUN consecutive lines; of every WINDOW such hashes in a row the least is selected, so each run of
RUN + WINDOW - 1 lines holds a selected fingerprint wherever it stands. The first occurrence of a fingerprint may be a short one that says
nothing of what stands around later ones. So each fingerprint is also taken with its context: every RUN + WINDOW - 1 lines around it, which
by the guarantee are all the runs of that length, are a key with a first occurrence of its own. A run of that length that stands
earlier is therefore always found, whoever owns its parts; shorter ones are found where they hold a selected fingerprint whose first occurrence they
are equal to. A line of SOLO_CHARS characters or more is a run by itself and a fingerprint of its own kind.

The first occurrence - by document, then by line - is found by an aggregation that combines map-side, the others are joined to it,
and each match is extended both ways over the two documents' line hashes. A line goes if some run that holds it
begins earlier elsewhere, so the first occurrence of every deleted line stays.

Only line hashes move between stages; texts move once, to be rewritten, by the same sort-merge join at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import dealt_join, quoted, saved, small_batches, table, whole

RUN, WINDOW, SOLO_CHARS = 2, 3, 64
DEALT, DEALT_KEY, ROWS = 256, 20_000, 512
SPACES = " \t\n\x0b\x0c\r"
NO_ID = -(2**63)


def line_hashes(lines: list[str]) -> np.ndarray:
    """XXH64 of each line without the white space around it."""
    return np.array([xxhash.xxh64_intdigest(x.strip(SPACES).encode("utf-8", "surrogatepass")) for x in lines], np.uint64)


def run_hashes(lines: np.ndarray, length: int = RUN) -> np.ndarray:
    """A hash for each `length` consecutive lines (for each line where there are fewer: none)."""
    n = len(lines) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for i in range(length):
        out = (out ^ lines[i : i + n]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(32)
    return out


def minima(hashes: np.ndarray, window: int = WINDOW) -> list[int]:
    """Positions of window minima, the rightmost of equal ones; fewer hashes than a window are one window."""
    if not len(hashes):
        return []
    picked: list[int] = []
    values = hashes.tolist()
    for end in range(min(window, len(values)), len(values) + 1):
        start = max(0, end - window)
        best = min(range(start, end), key=lambda i: (values[i], -i))
        if not picked or picked[-1] != best:
            picked.append(best)
    return picked


def fingerprint_lines(text: str) -> tuple[np.ndarray, list[int], list[int]]:
    """Line hashes of a text, and its fingerprints as hashes and first lines. Runs of blank lines give none."""
    lines = text.split("\n")
    hashes = line_hashes(lines)
    filled = np.array([bool(x.strip(SPACES)) for x in lines], bool)
    runs = run_hashes(hashes)
    keys, at = [], []
    some = np.convolve(filled, np.ones(RUN, int), "valid") > 0 if len(runs) else np.zeros(0, bool)
    for i in minima(np.where(some, runs, np.uint64(2**64 - 1))):  # a blank run takes no other's place in a window
        if some[i]:
            keys.append(int(runs[i]))
            at.append(i)
    whole = RUN + WINDOW - 1
    for i, key in enumerate(run_hashes(hashes, whole).tolist()):
        if filled[i : i + whole].any():
            keys.append(key ^ 0x3333333333333333)
            at.append(i)
    for i in np.flatnonzero(np.fromiter(map(len, lines), np.int64, len(lines)) >= SOLO_CHARS).tolist():
        if filled[i]:
            keys.append(int(hashes[i]) ^ 0x5555555555555555)  # another kind of key than a run's
            at.append(i)
    return hashes, keys, at


def extend(a: np.ndarray, b: np.ndarray, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs [start, end) of lines of `a` around the matched positions (p in a, q in b), extended both ways as far as the lines are equal."""
    runs: dict[int, list[tuple[int, int]]] = {}
    for p, q in sorted(pairs):
        done = runs.setdefault(p - q, [])
        if done and p < done[-1][1] or a[p] != b[q]:
            continue
        start, end = p, p + 1
        while start and start - (p - q) > 0 and a[start - 1] == b[start - 1 - (p - q)]:
            start -= 1
        while end < len(a) and end - (p - q) < len(b) and a[end] == b[end - (p - q)]:
            end += 1
        done.append((start, end))
    return sorted({x for done in runs.values() for x in done})


def repeated_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, hash (of the text), runs: array of (start, end) lines of later occurrences, for each document that has some.

    A document is an id with a text: null ids come first in the order of documents, rows equal in both are one document.
    """
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("lines", pa.binary()), ("keys", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))])

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(it):
            rows = [fingerprint_lines(t.as_py()) for t in batch.column(2)]
            keys = [np.array(k, np.uint64).view(np.int64) for _, k, _ in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([h.tobytes() for h, _, _ in rows], pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array([a for _, _, a in rows], pa.list_(pa.int32()))], schema=schema)

    with small_batches(df.sparkSession):
        measured = saved(docs.select("id", F.xxhash64("text").alias("hash"), "text").mapInArrow(measure, "id long, hash long, lines binary, keys array<long>, at array<int>"))
    spots = measured.select("id", "hash", F.explode(F.arrays_zip("keys", "at")).alias("x")).select("id", "hash", F.col("x.keys").alias("key"), F.col("x.at").alias("at"))
    first = saved(spots.groupBy("key").agg(F.min(F.struct("id", "hash", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", F.col("first.id").alias("id2"), F.col("first.hash").alias("hash2"), F.col("first.at").alias("at2"), "n"))
    later = dealt_join(spots, first, ["key"], ["id", "hash"], DEALT_KEY, rows="n").where("id <> id2 OR hash <> hash2 OR at <> at2")
    pairs = saved(later.groupBy("id", "hash", "id2", "hash2").agg(F.collect_list(F.struct("at", "at2")).alias("pairs")))  # as many as a document has fingerprints at most
    lines = measured.select("id", "hash", "lines").dropDuplicates(["id", "hash"])
    copies = lines.select(F.col("id").alias("id2"), F.col("hash").alias("hash2"), F.col("lines").alias("lines2"))
    both = dealt_join(pairs, copies, ["id2", "hash2"], ["id", "hash"], DEALT).join(lines, ["id", "hash"])
    out = pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def match(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(it):
            found = []
            for a, b, p in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                runs = extend(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64), [(x["at"], x["at2"]) for x in p.as_py()])
                found.append([{"start": s, "end": e} for s, e in runs])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, out.field(2).type)], schema=out)

    runs = both.select("id", "hash", "lines", "lines2", "pairs").mapInArrow(match, "id long, hash long, runs array<struct<start: int, end: int>>")
    return runs.groupBy("id", "hash").agg(F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with later occurrences of repeated runs of lines cut from its texts, and n_lines, n_removed_lines.

    Every row stays, with an empty text if all its lines occur earlier. Null texts stay null with no lines. Rows equal in id and
    text are one document and keep the same lines. An empty table gives an empty result. All columns of `df` stay in their
    order; columns named n_lines or n_removed_lines give way.
    """
    new = ["n_lines", "n_removed_lines"]
    stay = [c for c in df.columns if c.lower() not in new]
    with small_batches(df.sparkSession):
        runs = saved(repeated_runs(df, id_col, text_col))
    keyed = df.select(whole(df.select(*map(quoted, stay))).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("own_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("own_hash"))
    joined = keyed.join(runs.hint("merge"), (F.col("own_id") == F.col("id")) & (F.col("own_hash") == F.col("hash")), "left").select("row", "runs")
    at = stay.index(text_col)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(it):
            row = batch.column(0)
            columns, names = row.flatten(), [row.type.field(i).name for i in range(row.type.num_fields)]
            texts, n, gone = [], [], []
            for text, spans in zip(columns[at], batch.column(1), strict=True):
                text, spans = text.as_py(), spans.as_py()
                lines = text.split("\n") if text is not None else []
                drop = {i for s in spans or () for i in range(s["start"], s["end"])} if lines else set()
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text)
                n.append(len(lines))
                gone.append(len(drop))
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, names), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=["row", *new])

    schema = T.StructType([joined.schema["row"], *(T.StructField(c, T.LongType()) for c in new)])
    return joined.mapInArrow(cut, schema).select("row.*", *new)


def _slices(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some rows of a batch at a time: what is made of them in Python stays small."""
    for batch in it:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with later repeats of lines cut."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
