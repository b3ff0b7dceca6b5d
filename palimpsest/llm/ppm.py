"""Prediction by partial matching over bytes, with a pretrained context trie.

A text, A-Z lower-cased, is its UTF-8 bytes and an end symbol, behind ORDER start symbols (0xFF and 0xFE never occur in UTF-8). A byte is coded in
the longest of its contexts of ORDER, ..., 1, 0 bytes that the training documents know. By escape method D a symbol seen n times among T in a
context of D different ones has probability (2n - 1) / 2T, and D / 2T is for the escape to the next shorter context, where the symbols of the
longer one are excluded; after the empty context the remaining symbols are equally likely. Contexts cross words, lines and white space.

The trie is never in one place. Its edges are the distinct (ORDER + 1)-grams of bytes, and each shorter level is an aggregation of
the one above; what a context and its exclusions come to is joined to it. All grams of the corpus get their code length by one join for each level, and
only grams that are still undecided go down a level.

Documents are dealt into blocks of some 40 MB of text, and a block is read in the order of a hash of its documents. A stretch of it ends when its
distinct grams or its distinct words pass a bound, so what a task holds is bounded by MOST_GRAMS and MOST_WORD_BYTES and the longest
document, whatever the text is like. A stretch says which words and grams it has, gets back their counts and code lengths, and scores its
documents by table look-ups. So what moves is a stretch's vocabulary, not a row for each word of each document; documents
stream, and long ones are read in slices. Grams and words are held in arrays. A stretch knows its words by 64-bit hashes that are made for all
words of a chunk at once; where two of its words share one, it takes another seed, so look-ups are exact.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import saved, scratch, small_batches, table

ORDER = 5
START, END = b"\xfe", b"\xff"
ALPHABET = 255  # all bytes but START
BLOCK_BYTES, LEAST_BLOCKS = 40_000_000, 6
CHUNK, TALLY_CHUNK = 256 << 10, 1 << 20
MOST_GRAMS, MOST_WORD_BYTES, WORD_CHUNK = 2_000_000, 16_000_000, 50_000
NO_PLACE = -(2**63)
FOLDS, HELD_OUT = 7, 2
SEED, WORD, GRAM, TEXT = -1, 0, 1, 2
SPACE = re.compile(rb"[\x20\x09-\x0D]")
WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def folded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def is_held_out(id_: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT


def slices(data: bytes, size: int = CHUNK) -> Iterator[bytes]:
    """A text, some `size` bytes at a time; a slice ends in front of white space, so no word is cut."""
    at = 0
    while len(data) - at > size:
        found = SPACE.search(data, at + size)
        end = found.start() if found else len(data)
        yield data[at:end]
        at = end
    yield data[at:]


@functools.lru_cache(2)
def _powers(seed: int) -> tuple[np.ndarray, np.ndarray]:
    base = (0x9E3779B97F4A7C15 + 2 * seed * 0xC2B2AE3D27D4EB4F) % 2**64 | 1
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * CHUNK, x % 2**64, np.uint64)])) for x in (base, pow(base, -1, 2**64)))


def word_hashes(data: bytes, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of a text: of a polynomial for words up to 255 bytes, XXH64 for longer ones."""
    own = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], ~WHITE[own], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    long = np.flatnonzero(ends - starts > 255)
    if len(own) <= 2 * CHUNK:
        powers, inverse = _powers(seed)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((own.astype(np.uint64) + np.uint64(1)) * powers[: len(own)])])
        out = (sums[ends] - sums[starts]) * inverse[starts]
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(28)
    else:  # a slice is only this long if it is one word
        out, long = np.zeros(len(starts), np.uint64), np.arange(len(starts))
    for i in long.tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]], seed)
    return out, starts


def hashes_of(words: pa.Array) -> tuple[int, np.ndarray]:
    """A seed by which no two of these words, all different, have the same hash, and the hashes."""
    seed = 0
    while True:
        out = np.zeros(len(words), np.uint64)
        at = 0
        while at < len(words):
            own = words[at : at + 4096].to_pylist()
            while len(own) > 1 and sum(map(len, own)) + len(own) > CHUNK:
                own = own[: len(own) // 2]
            out[at : at + len(own)] = word_hashes(b" ".join(own), seed)[0]
            at += len(own)
        if len(np.unique(out)) == len(out):
            return seed, out
        seed += 1


def grams_of(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The packed (order + 1)-grams of each coded symbol of the texts in a row, and where each text's grams begin."""
    joined = b"".join(x for t in texts for x in (START * order, t, END))
    data = np.frombuffer(joined, np.uint8).astype(np.uint64)
    n = len(data) - order
    grams = data[:n].copy()
    for i in range(1, order + 1):
        grams <<= np.uint64(8)
        grams |= data[i : i + n]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    if len(texts) > 1:
        keep = np.ones(n, bool)
        nexts = np.cumsum(lengths + order)[:-1]
        keep[(nexts[:, None] - np.arange(1, order + 1)).ravel()] = False  # windows that reach into the next text
        grams = grams[keep]
    return grams, np.cumsum(lengths) - lengths


def chunks(texts: Iterator[tuple[int, bytes]], order: int = ORDER, chunk: int = CHUNK) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Numbers, grams and beginnings for some texts at a time; a text above `chunk` bytes comes in slices of its own."""
    held: list[tuple[int, bytes]] = []
    size = 0
    for number, data in texts:
        if len(data) > chunk:
            full = np.frombuffer(START * order + data + END, np.uint8)
            for at in range(0, len(full) - order, chunk):
                part = full[at : at + chunk + order].astype(np.uint64)
                grams = part[: len(part) - order].copy()
                for i in range(1, order + 1):
                    grams <<= np.uint64(8)
                    grams |= part[i : i + len(grams)]
                yield [number], grams, np.zeros(1, np.int64)
            continue
        held.append((number, data))
        size += len(data) + 1
        if size > chunk:
            yield [i for i, _ in held], *grams_of([t for _, t in held], order)
            held, size = [], 0
    if held:
        yield [i for i, _ in held], *grams_of([t for _, t in held], order)


class _Tally:
    """Distinct grams of one stretch, in order, with their counts in training texts."""

    def __init__(self, order: int) -> None:
        self.order, self.waiting, self.sizes = order, {True: [], False: []}, {True: 0, False: 0}
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, data: bytes, train: bool) -> None:
        self.waiting[train].append(data)
        self.sizes[train] += len(data) + 1
        if self.sizes[train] >= TALLY_CHUNK:
            self.flush(train)

    def flush(self, train: bool) -> None:
        for _, grams, _ in chunks(enumerate(self.waiting[train]), self.order, TALLY_CHUNK):
            keys, counts = np.unique(grams, return_counts=True)
            counts *= train
            at = np.searchsorted(self.keys, keys)
            known = np.zeros(len(keys), bool)
            inside = at < len(self.keys)
            known[inside] = self.keys[at[inside]] == keys[inside]
            self.counts[at[known]] += counts[known]
            self.keys, self.counts = np.insert(self.keys, at[~known], keys[~known]), np.insert(self.counts, at[~known], counts[~known])
        self.waiting[train], self.sizes[train] = [], 0

    def full(self, most: int) -> bool:
        """Whether there are nearly `most` distinct grams. What waits is counted as distinct first, and exactly where that is too many."""
        if len(self.keys) + sum(self.sizes.values()) <= most:
            return False
        self.flush(True)
        self.flush(False)
        return len(self.keys) > most * 0.9

    def told(self) -> tuple[np.ndarray, np.ndarray]:
        self.flush(True)
        self.flush(False)
        return self.keys, self.counts


class _Words:
    """Distinct words of one stretch with their counts in training texts, in Arrow arrays; at most WORD_CHUNK or so wait as Python objects."""

    def __init__(self) -> None:
        self.counts, self.others = Counter(), set()
        self.merged, self.parts, self.new = pa.table({"word": pa.array([], pa.binary()), "n": pa.array([], pa.int64())}), [], 0

    def add(self, data: bytes, train: bool) -> None:
        for part in slices(data):
            (self.counts if train else self.others).update(part.split())
            if len(self.counts) + len(self.others) >= WORD_CHUNK:
                self.flush()

    def flush(self) -> None:
        words = [*self.counts, *self.others]
        self.parts.append(pa.table({"word": pa.array(words, pa.binary()), "n": pa.array([*self.counts.values(), *([0] * len(self.others))], pa.int64())}))
        self.counts, self.others = Counter(), set()
        self.new += len(words)
        if self.new > self.merged.num_rows // 2:
            self.merge()

    def merge(self) -> None:
        self.merged = pa.concat_tables([self.merged, *self.parts]).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])
        self.parts, self.new = [], 0

    def size(self) -> int:
        return self.merged.nbytes + sum(p.nbytes for p in self.parts)

    def told(self) -> pa.Table:
        self.flush()
        self.merge()
        return self.merged


class Lookup:
    """Values of keys (each once) in an open hash table of their numbers, looked up for a whole array at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(10, math.ceil(math.log2(max(1, len(keys)) * 1.6)))
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys, self.values, self.item = keys, values, np.full(1 << bits, -1, np.int32)
        slot, left = self._slots(keys), np.arange(len(keys), dtype=np.int32)
        while len(left):
            free = self.item[slot] < 0
            self.item[slot[free]] = left[free]  # of several for one slot the last is in
            stay = self.item[slot] != left
            left, slot = left[stay], (slot[stay] + np.uint64(1)) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slots(keys)
        item = self.item[slot]
        left = np.flatnonzero((item < 0) | (self.keys[item] != keys))
        slot = slot[left]
        while len(left):
            slot = (slot + np.uint64(1)) & self.mask
            now = self.item[slot]
            if (now < 0).any():
                raise KeyError("what is looked up was never told")
            found = self.keys[now] == keys[left]
            item[left[found]] = now[found]
            left, slot = left[~found], slot[~found]
        return self.values[item]


def vocabulary(docs: DataFrame, blocks: int, order: int = ORDER) -> DataFrame:
    """kind, block, place, word, key, n: the distinct words and grams of each stretch with their counts in its training texts; key is the gram or the word's hash, or a seed of those.

    `docs` has block, place, held_out and text. A stretch is all documents of a block from a place on up to the next one's; the first begins at NO_PLACE.
    """
    schema = pa.schema([("kind", pa.int32()), ("block", pa.int32()), ("place", pa.int64()), ("word", pa.binary()), ("key", pa.int64()), ("n", pa.int64())])

    def told(block: int, place: int, words: _Words, tally: _Tally) -> Iterator[pa.RecordBatch]:
        def batch(kind: int, word: pa.Array | None, key: np.ndarray, n: pa.Array) -> pa.RecordBatch:
            of = lambda value, type_: pa.array(np.full(len(key), value, type_))
            return pa.RecordBatch.from_arrays([of(kind, np.int32), of(block, np.int32), of(place, np.int64), pa.nulls(len(key), pa.binary()) if word is None else word, pa.array(key.view(np.int64)), n], schema=schema)

        listed = words.told().combine_chunks()
        seed, hashes = hashes_of(listed.column(0))
        yield batch(SEED, None, np.array([seed], np.uint64), pa.array([0]))
        at = 0
        for part in listed.to_batches(max_chunksize=50_000):
            yield batch(WORD, part.column(0), hashes[at : at + part.num_rows], part.column(1))
            at += part.num_rows
        grams, n = tally.told()
        for at in range(0, len(grams), 50_000):
            yield batch(GRAM, None, grams[at : at + 50_000], pa.array(n[at : at + 50_000]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begin, last, words, tally = None, NO_PLACE, None, _Words(), _Tally(order)
        for batch in it:
            for block, place, held, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                full = place != last and (tally.full(MOST_GRAMS) or words.size() > MOST_WORD_BYTES)
                if block != now or full:
                    if now is not None:
                        yield from told(now, begin, words, tally)
                    begin = NO_PLACE if block != now else place
                    now, words, tally = block, _Words(), _Tally(order)
                last = place
                data = folded(text.as_py())
                words.add(data, not held)
                tally.add(data, not held)
        if now is not None:
            yield from told(now, begin, words, tally)

    dealt = _dealt(docs.select("block", "place", "held_out", "text"), blocks).sortWithinPartitions("block", "place")
    return dealt.mapInArrow(run, "kind int, block int, place long, word binary, key long, n long")


def _dealt(df: DataFrame, blocks: int) -> DataFrame:
    """One block for each partition, or as many blocks as there are more of them than the session's shuffle partitions."""
    parts = min(blocks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartitionById(parts, F.col("block") % parts)


def _suffix(col: str, symbols: int) -> Column:
    return F.col(col).bitwiseAND(F.lit((1 << (8 * symbols)) - 1))


def code_lengths(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, value (log10 probability of its last symbol after the others) for every row of `grams` (gram, n in training texts; each gram once)."""
    levels = {order: saved(grams.where("n > 0"))}
    for k in range(order - 1, -1, -1):
        levels[k] = saved(levels[k + 1].groupBy(_suffix("gram", k + 1).alias("gram")).agg(F.sum("n").alias("n")))
    context = F.shiftright("gram", 8).alias("context")
    plain = {k: level.groupBy(context).agg(F.sum("n").alias("t"), F.count("*").alias("d")) for k, level in levels.items()}
    # what is left of the next shorter context once the symbols of this one are excluded
    nodes = {0: plain[0].withColumns({"t_below": F.lit(0).cast("long"), "d_below": F.lit(0).cast("long")})}
    for k in range(1, order + 1):
        low = levels[k - 1].select(F.col("gram").alias("low"), F.col("n").alias("low_n"))
        seen = levels[k].withColumn("low", _suffix("gram", k)).join(_small(low, k - 1), "low").groupBy(context).agg(F.sum("n").alias("t"), F.count("*").alias("d"), F.sum("low_n").alias("gone"))
        below = plain[k - 1].select(F.col("context").alias("shorter"), F.col("t").alias("t_short"), F.col("d").alias("d_short"))
        nodes[k] = seen.withColumn("shorter", _suffix("context", k - 1)).join(_small(below, k - 1), "shorter").select("context", "t", "d", (F.col("t_short") - F.col("gone")).alias("t_below"), (F.col("d_short") - F.col("d")).alias("d_below"))
    open_ = grams.select("gram", F.lit(0.0).alias("value"), F.lit(None).cast("long").alias("t_now"), F.lit(None).cast("long").alias("d_now"))
    closed: list[DataFrame] = []
    for k in range(order, -1, -1):
        own = open_.withColumns({"own": _suffix("gram", k + 1), "context": _suffix("gram", k + 1)}).withColumn("context", F.shiftright("own", 8))
        own = own.join(_small(levels[k].select(F.col("gram").alias("own"), "n"), k), "own", "left").join(_small(nodes[k], k), "context", "left")
        t, d = F.coalesce("t_now", "t"), F.coalesce("d_now", "d")
        own = own.select("gram", "n", "value", t.alias("t"), d.alias("d"), F.coalesce("t_below", "t_now").alias("t_next"), F.coalesce("d_below", "d_now").alias("d_next"), F.col("t_below").isNotNull().alias("known"), F.col("d_now").alias("d_was"))
        own = saved(own)
        closed.append(own.where("n IS NOT NULL").select("gram", (F.col("value") + F.log10((2 * F.col("n") - 1) / (2 * F.col("t")))).alias("value")))
        paid = F.when(F.col("known") & (F.col("d") > 0), F.log10(F.col("d") / (2 * F.col("t")))).otherwise(0.0)
        open_ = own.where("n IS NULL").select("gram", (F.col("value") + paid).alias("value"), F.col("t_next").alias("t_now"), F.col("d_next").alias("d_now"))
    used = plain[0].agg(F.coalesce(F.sum("d"), F.lit(0))).first()[0]
    closed.append(open_.select("gram", (F.col("value") - F.log10(F.lit(float(max(1, ALPHABET - used))))).alias("value")))
    out = closed[0]
    for x in closed[1:]:
        out = out.union(x)
    return out


def _small(df: DataFrame, level: int) -> DataFrame:
    """Levels 0 and 1 have at most 256 and 65,536 grams, whatever the corpus."""
    return F.broadcast(df) if level <= 1 else df


def score_documents(df: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every row of `df`, learned from rows whose crc32(id as text) mod 7 is not 2 (a null id counts as '').

    Returns id, held_out, n_tokens (words and one end), n_known, train_tokens, base_score (word frequencies, add-one), score (log10
    probability of the bytes and the end), n_symbols (bytes and the end). Null texts are empty: one end. Repeated rows count, and stay, as often as they occur. Without any training row base_score is
    0 and every symbol equally likely. An empty table gives an empty result; other columns of `df` are not read.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), is_held_out(F.col(id_col)).alias("held_out"))
    size, trained = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum((~F.col("held_out")).cast("long")), F.lit(0))).first()
    blocks = LEAST_BLOCKS + size // BLOCK_BYTES
    docs = docs.withColumn("place", F.xxhash64("id", "text")).withColumn("block", F.pmod("place", F.lit(blocks)).cast("int"))
    with small_batches(df.sparkSession):
        found = saved(vocabulary(docs, blocks, order))
    same = W.partitionBy("word")
    words = saved(found.where(F.col("kind") == WORD).select("block", "place", "key", F.sum("n").over(same).alias("c"), (F.struct("block", "place") == F.min(F.struct("block", "place")).over(same)).alias("first")))
    total, distinct = words.where("first AND c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = total + trained, distinct + (trained > 0)
    grams = found.where(F.col("kind") == GRAM).select("block", "place", F.col("key").alias("gram"), "n")
    with scratch(df.sparkSession) as out:
        lengths = out(code_lengths(saved(grams.groupBy("gram").agg(F.sum("n").alias("n"))), order))
    columns = {"kind": "int", "block": "int", "place": "long", "key": "long", "value": "double", "id": "long", "held_out": "boolean", "text": "string"}

    def shaped(x: DataFrame, kind: int) -> DataFrame:
        return x.select(*[F.lit(kind).alias(c) if c == "kind" else F.col(c) if c in x.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()])

    every = shaped(found.where(F.col("kind") == SEED), SEED).union(shaped(words.withColumn("value", F.log10(F.col("c") + 1)), WORD))
    every = every.union(shaped(grams.join(lengths, "gram").withColumnRenamed("gram", "key"), GRAM)).union(shaped(docs, TEXT))
    dealt = _dealt(every, blocks).sortWithinPartitions("block", "place", "kind")
    schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()), ("n_symbols", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seed, words, grams, lookups = None, 0, [], [], None
        table = lambda parts: Lookup(*(np.concatenate(x) for x in zip((np.zeros(0, np.uint64), np.zeros(0)), *parts, strict=True)))
        for batch in it:
            kinds, own, places = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((kinds[1:] != kinds[:-1]) | (own[1:] != own[:-1]) | (places[1:] != places[:-1]) & (kinds[1:] != TEXT)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if kinds[a] != TEXT and (own[a], places[a]) != now:
                    now, words, grams, lookups = (own[a], places[a]), [], [], None
                if kinds[a] == SEED:
                    seed = part.column(3)[0].as_py()
                elif kinds[a] != TEXT:
                    (words if kinds[a] == WORD else grams).append((part.column(3).to_numpy().view(np.uint64).copy(), part.column(4).to_numpy().copy()))
                else:
                    if lookups is None:
                        lookups = table(words), table(grams)
                        words, grams = [], []
                    yield scored(part, seed, *lookups)

    def scored(part: pa.RecordBatch, seed: int, words: Lookup, lookup: Lookup) -> pa.RecordBatch:
        n = part.num_rows
        tokens, known, symbols = np.ones(n, np.int64), np.full(n, int(trained > 0), np.int64), np.ones(n, np.int64)
        logs, score = np.zeros(n), np.zeros(n)
        waiting: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            nonlocal waiting, size
            ends = np.cumsum([len(x) + 1 for _, x in waiting])
            hashes, starts = word_hashes(b" ".join([x for _, x in waiting]), seed)
            got = words(hashes)
            at = np.array([i for i, _ in waiting], np.int64)[np.searchsorted(ends, starts, "right")]
            np.add(tokens, np.bincount(at, minlength=n), out=tokens)
            np.add(known, np.bincount(at[got > 0], minlength=n), out=known)
            np.add(logs, np.bincount(at, got, n), out=logs)
            waiting, size = [], 0

        def texts() -> Iterator[tuple[int, bytes]]:
            nonlocal size
            for i, text in enumerate(part.column(7)):
                data = folded(text.as_py())
                symbols[i] += len(data)
                for x in slices(data):
                    if waiting and size + len(x) + 1 > CHUNK:
                        flush()
                    waiting.append((i, x))
                    size += len(x) + 1
                yield i, data
            if waiting:
                flush()

        for numbers, grams, starts in chunks(texts(), order):
            np.add.at(score, numbers, np.add.reduceat(lookup(grams), starts))
        made = [part.column(5), part.column(6), *map(pa.array, (tokens, known, logs, score, symbols))]
        return pa.RecordBatch.from_arrays(made, schema=schema)

    with small_batches(df.sparkSession):
        out = saved(dealt.mapInArrow(run, "id long, held_out boolean, n_tokens long, n_known long, logs double, score double, n_symbols long"))
    end, norm = math.log10(trained + 1), math.log10(total + distinct + 1)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("logs") + F.lit(end) - F.col("n_tokens") * F.lit(norm)).alias("base_score"), "score", "n_symbols")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return score_documents(table(spark, sf_dir, "documents"))
