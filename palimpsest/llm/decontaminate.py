"""Benchmark passages in documents: item-sized windows, their SimHash fingerprints looked up by Hamming blocks, and exact verification.

Similarity is that of weighted 5-word shingles, the sum of the lesser over the sum of the greater counts, and 0.8 or more is a
leak. Every window as long as an item is considered. One of m shingles can only reach 0.8 with an item of n if at least 0.8 / 1.8 of m + n of
its shingles stand in items of that length at all; running sums tell that, and windows below it are done with, without a loss. The others are
fingerprinted and looked up among the items of their length in an index of BLOCKS blocks of 16 bits. Two fingerprints within
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1 = 19 bits agree up to BLOCK_RADIUS = 4 bits in some block, so the index finds every item within
the radius, and one random pair in seven. What is found within the radius is verified. At similarity 0.8 about 10 bits differ, with a deviation
of 3, so some one leak in a thousand at the very threshold lies beyond.

The benchmark is a stated query set. It is broadcast in blocks of at most ITEM_BYTES of text, one at a time; each further block is a pass over
the documents, written before the next one begins. Documents are not shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import folded_words, quoted, saved, table, whole
from palimpsest.llm.simhash import majority, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, BLOCK_RADIUS = 4, 4
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
ITEM_BYTES = 16 << 20
TABLE_BITS = 22
CELLS = 1 << 20
LEAK = "array<struct<item_id: long, start_word: int, n_words: int, distance: int, similarity: double>>"


def ball(radius: int = BLOCK_RADIUS, bits: int = 16) -> np.ndarray:
    """All values of `bits` bits with at most `radius` of them set."""
    return np.array([sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(bits), r)], np.uint16)


BALL = ball()


class HammingIndex:
    """Fingerprints by their blocks of 16 bits: all within RADIUS are found, by probing a block's neighbours or, where fewer, its listed values."""

    def __init__(self, prints: np.ndarray) -> None:
        self.prints = prints
        own = np.ascontiguousarray(prints).view(np.uint16).reshape(-1, BLOCKS)
        self.order = [np.argsort(own[:, b], kind="stable").astype(np.int32) for b in range(BLOCKS)]
        listed = [np.unique(own[:, b], return_index=False, return_counts=True) for b in range(BLOCKS)]
        self.values = [v for v, _ in listed]
        self.ends = [np.concatenate([[0], np.cumsum(n)]) for _, n in listed]

    def _block(self, b: int, value: int) -> np.ndarray:
        """Items up to BLOCK_RADIUS bits away from `value` in block b."""
        values, ends = self.values[b], self.ends[b]
        if len(values) <= len(BALL):
            at = np.flatnonzero(np.bitwise_count(values ^ np.uint16(value)) <= BLOCK_RADIUS)
        else:
            near = BALL ^ np.uint16(value)
            at = np.searchsorted(values, near)
            at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == near)]
        return self.order[b][np.repeat(ends[at] - np.concatenate([[0], np.cumsum(ends[at + 1] - ends[at])[:-1]]), ends[at + 1] - ends[at]) + np.arange((ends[at + 1] - ends[at]).sum())] if len(at) else np.zeros(0, np.int32)

    def all_within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For many fingerprints: which of them, the items within RADIUS and their distances."""
        if len(self.prints) > len(BALL):
            found = [self.within(x) for x in prints.tolist()]
            at = np.repeat(np.arange(len(prints)), [len(k) for k, _ in found])
            return at, np.concatenate([k for k, _ in found]), np.concatenate([d for _, d in found])
        near = np.zeros((len(prints), len(self.prints)), bool)
        for b, (own, listed) in enumerate(zip(prints.view(np.uint16).reshape(-1, BLOCKS).T, self.values, strict=True)):
            close = np.bitwise_count(own[:, None] ^ listed[None, :]) <= BLOCK_RADIUS
            near[:, self.order[b]] |= np.repeat(close, np.diff(self.ends[b]), axis=1)
        at, k = np.nonzero(near)
        distance = np.bitwise_count(prints[at] ^ self.prints[k])
        keep = distance <= RADIUS
        return at[keep], k[keep], distance[keep]

    def candidates(self, fingerprint: int) -> np.ndarray:
        """Items that some block has near; all within RADIUS are among them."""
        blocks = np.array([fingerprint], np.uint64).view(np.uint16)
        return np.unique(np.concatenate([self._block(b, int(blocks[b])) for b in range(BLOCKS)]))

    def within(self, fingerprint: int) -> tuple[np.ndarray, np.ndarray]:
        """Items within RADIUS and their distances."""
        found = self.candidates(fingerprint)
        distance = np.bitwise_count(self.prints[found] ^ np.uint64(fingerprint))
        return found[distance <= RADIUS], distance[distance <= RADIUS]


class Items:
    """Benchmark items of one shingle size (items shorter than SHINGLE words are one shingle of their own size), by their number of shingles."""

    def __init__(self, size: int, items: list[tuple[int, list[bytes]]]) -> None:
        self.size = size
        self.ids = [i for i, _ in items]
        self.words = [len(ws) for _, ws in items]
        self.hashes = [shingle_hashes(ws, size) for _, ws in items]
        self.known = np.unique(np.concatenate(self.hashes))
        self.maybe = np.zeros(1 << TABLE_BITS, bool)
        self.maybe[self.known >> np.uint64(64 - TABLE_BITS)] = True
        of: dict[int, list[int]] = {}
        for k, h in enumerate(self.hashes):
            of.setdefault(len(h), []).append(k)
        self.of_length = {n: (np.array(ks), np.unique(np.concatenate([self.hashes[k] for k in ks])), HammingIndex(np.array([majority(self.hashes[k]) for k in ks], np.uint64))) for n, ks in sorted(of.items())}

    def stand_in(self, hashes: np.ndarray) -> np.ndarray:
        """Which shingles of a document some item has."""
        out = self.maybe[hashes >> np.uint64(64 - TABLE_BITS)]
        at = np.flatnonzero(out)
        if len(at):
            place = np.minimum(np.searchsorted(self.known, hashes[at]), len(self.known) - 1)
            out[at] = self.known[place] == hashes[at]
        return out

    def leaks(self, hashes: np.ndarray) -> list[dict]:
        """The best window for each item that some window of a document with these shingle hashes reaches."""
        total = len(hashes)
        if not total:
            return []
        hits = np.flatnonzero(self.stand_in(hashes))
        best: dict[int, tuple] = {}
        for n, (ks, known, index) in self.of_length.items():
            m = min(n, total)
            need = math.ceil(SIMILARITY / (1 + SIMILARITY) * (m + n) - 1e-9)
            if need > min(m, len(hits)):
                continue
            place = np.minimum(np.searchsorted(known, hashes[hits]), len(known) - 1)
            own = hits[known[place] == hashes[hits]]
            if need > len(own):
                continue
            before = np.zeros(total + 1, np.int64)
            before[own + 1] = 1
            before = np.cumsum(before)
            starts = np.flatnonzero(before[m:] - before[: total - m + 1] >= need)
            width = max(1, CELLS // min(len(ks), len(BALL)))
            for at in range(0, len(starts), width):
                own = starts[at : at + width]
                w, k, distance = index.all_within(window_prints(hashes, own, m))
                last, counts = -1, Counter()
                for s, k1, d in zip(own[w].tolist(), ks[k].tolist(), distance.tolist(), strict=True):
                    if s != last:
                        last, counts = s, Counter(hashes[s : s + m].tolist())
                    similarity = weighted(counts, Counter(self.hashes[k1].tolist()))
                    if similarity >= SIMILARITY:
                        best[k1] = min(best.get(k1, (0.0, 0, 0)), (-similarity, s, d))
        return [{"item_id": self.ids[k], "start_word": s, "n_words": self.words[k], "distance": d, "similarity": -x} for k, (x, s, d) in sorted(best.items(), key=lambda y: self.ids[y[0]])]


def weighted(a: Counter, b: Counter) -> float:
    """Sum of the lesser over sum of the greater counts."""
    low = sum(min(n, b[h]) for h, n in a.items() if h in b)
    return low / (sum(a.values()) + sum(b.values()) - low)


def window_prints(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of hashes[s : s + n] for each start, by running sums over the stretches that windows cover."""
    out = np.zeros(len(starts), np.uint64)
    breaks = np.flatnonzero(np.diff(starts) > n) + 1
    for part in np.split(np.arange(len(starts)), breaks):
        for piece in np.array_split(part, -(-len(part) // 4096)):
            low, high = int(starts[piece[0]]), min(len(hashes), int(starts[piece[-1]]) + n)
            own = np.ascontiguousarray(hashes[low:high])
            votes = np.zeros((len(own) + 1, 64), np.int32)
            np.cumsum(np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int32, out=votes[1:])
            a = starts[piece] - low
            b = np.minimum(a + n, len(own))
            out[piece] = np.packbits(2 * (votes[b] - votes[a]) > (b - a)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def item_index(rows: list[tuple[int, str]]) -> list[Items]:
    by_size: dict[int, list[tuple[int, list[bytes]]]] = {}
    for i, text in rows:
        if ws := folded_words(text):
            by_size.setdefault(min(SHINGLE, len(ws)), []).append((i, ws))
    return [Items(size, own) for size, own in sorted(by_size.items())]


def mark_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """`df` with a column leaks: for each benchmark item found the best window (item_id, start_word, n_words, distance, similarity).

    Words are compared with A-Z lower-cased. Null and empty texts leak nothing; items without a word or an id are no items; equal items are
    found each; a document shorter than an item is one window. Every row stays, with all columns of `df` (one named leaks gives way). Empty tables are fine.
    """
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    blocks = max(1, -(-total // ITEM_BYTES))
    stay = [c for c in df.columns if c.lower() != "leaks"]
    out = df.select(whole(df.select(*map(quoted, stay))).alias("row"), F.expr(f"CAST(array() AS {LEAK})").alias("leaks"))
    for b in range(blocks):
        index = item_index([tuple(r) for r in items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).orderBy("id", "text").collect()])
        if index:
            out = _mark(out, stay.index(text_col), index)
            out = saved(out) if b + 1 < blocks else out
    return out.select("row.*", "leaks")


def _mark(df: DataFrame, at: int, index: list[Items]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(index)  # of at most ITEM_BYTES of text
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int32()), ("n_words", pa.int32()), ("distance", pa.int32()), ("similarity", pa.float64())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in it:
            found = []
            for text, before in zip(batch.column(0).flatten()[at], batch.column(1), strict=True):
                ws = folded_words(text.as_py())
                leaks = [x for items in own if len(ws) >= items.size or items.size == SHINGLE for x in items.leaks(shingle_hashes(ws, items.size))]
                found.append([*before.as_py(), *leaks])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["row", "leaks"])

    return df.mapInArrow(run, T.StructType([df.schema["row"], T.StructField("leaks", T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start_word", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("distance", T.IntegerType()), T.StructField("similarity", T.DoubleType())])))]))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every benchmark item in it."""
    marked = mark_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
