"""SimHash fingerprints, links between fingerprints within a radius, and connected components.

Links are found among distinct fingerprints, so exact copies cost nothing. By the pigeonhole principle two fingerprints with
at most `radius` differing bits agree in all but `radius` of m bit blocks: there is a table for each choice of
m - radius blocks, and rows of one table with one key form a bucket. m grows with the number of fingerprints so that a random bucket
stays small; whatever m, no link is lost. Large buckets (near copies by the thousand) are dealt as pairs of parts.

Within a bucket, bit planes are stored vertically - word w of plane p holds bit p of 64 fingerprints - and 64 distances at once are summed by
carry-save adders, four planes a step. Blocks of 64 in which every lane is beyond the radius are abandoned. A bucket
gives the edges of a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import folded_words, saved, scratch, small_batches, table, whole

SEED, SHINGLE, RADIUS = 42, 4, 4
BUCKET, PART, BATCH = 256, 1024, 512
ONES = np.uint64(2**64 - 1)


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of each run of k words joined by spaces; of the whole sequence if it has fewer; none of none."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    return majority(shingle_hashes(folded_words(text), k))


def fingerprints(df: DataFrame, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, hash (of the text), fp (long: the 64 bits, signed) for every row of `df`; a text without words has fingerprint zero."""
    schema = pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("fp", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = np.array([fingerprint(x.as_py(), k) for x in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], schema=schema)

    return df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"), F.col(text_col).alias("text")).mapInArrow(run, "id long, hash long, fp long")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 planes by ceil(n / 64) words."""
    width = -(-len(fps) // 64) * 64
    bits = np.zeros((64, width), np.uint8)
    bits[:, : len(fps)] = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save: sum and carry of three bits in every lane."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def close_pairs(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of all pairs of `fps` (uint64) with at most `radius` < 8 differing bits."""
    if not 0 <= radius < 8:
        raise ValueError("the counters go up to 7")
    n = len(fps)
    planes = planes_of(fps)
    width = planes.shape[1]
    query, word = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(width), indexing="ij"))
    live = word * 64 + 63 > query  # blocks with a lane behind the query
    query, word = query[live], word[live]
    own = np.where((fps[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), ONES, np.uint64(0))
    c0, c1, c2, over = (np.zeros(len(query), np.uint64) for _ in range(4))
    beyond = over
    for p in range(0, 64, 4):
        x = [planes[q][word] ^ own[query, q] for q in range(p, p + 4)]
        c0, k1 = _add(c0, x[0], x[1])
        c0, k2 = _add(c0, x[2], x[3])
        c1, k4 = _add(c1, k1, k2)
        over |= c2 & k4
        c2 ^= k4
        if p % 16 == 12:
            beyond = _exceeds(c0, c1, c2, over, radius)
            if not (live := beyond != ONES).all():
                query, word, c0, c1, c2, over, beyond = (x[live] for x in (query, word, c0, c1, c2, over, beyond))
            if not len(query):
                break
    near = np.unpackbits((~beyond).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    block, lane = np.nonzero(near)
    i, j = query[block], word[block] * 64 + lane
    keep = (j > i) & (j < n)
    return i[keep], j[keep]


def _exceeds(c0: np.ndarray, c1: np.ndarray, c2: np.ndarray, over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count (bits c2 c1 c0, or eight and more) is over the radius."""
    more = np.zeros_like(over)
    same = np.full_like(over, ONES)
    for bit, plane in ((4, c2), (2, c1), (1, c0)):
        if radius & bit:
            same &= plane
        else:
            more |= same & plane
            same &= ~plane
    return over | more


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[list[int], list[int]]:
    """Each position that hangs below another with its root: edges of stars that connect what the pairs connect."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    low = [x for x in range(n) if root(x) != x]
    return low, [root(x) for x in low]


def block_masks(count: int, radius: int) -> list[int]:
    """A mask for each table: of m blocks all but `radius`, with m such that a random bucket has at most BUCKET of `count` fingerprints."""
    m = radius + 1
    while m < 64 and count / 2 ** (64 // m * (m - radius)) > BUCKET and math.comb(m + 1, radius) <= 2000:
        m += 1
    edges = [round(64 * i / m) for i in range(m + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    return [sum(chosen) for chosen in itertools.combinations(blocks, m - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) of long fingerprints that connect just what links within `radius` connect; `distinct` has a column fp, each value once."""
    masks = block_masks(distinct.count(), radius)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key")) for t, mask in enumerate(masks)])
    rows = distinct.select("fp", F.explode(tables).alias("of")).select("fp", "of.t", "of.key")
    large = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > PART)
    rows = rows.join(large, ["t", "key"], "left").withColumn("parts", F.ceil(F.coalesce("n", F.lit(1)) / PART).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = ["t", "key", "i", "j"]
    rows = rows.select("t", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "fp")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fps in _cells(it):
            fps = np.unique(fps)
            a, b = forest(len(fps), *close_pairs(fps, radius))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(fps[a].view(np.int64)), pa.array(fps[b].view(np.int64))], schema=schema)

    return rows.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(run, "a long, b long").distinct()


def _cells(it: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Fingerprints of some whole cells at a time; a cell has 2 * PART rows or so at most."""
    held: list[np.ndarray] = []
    n, last = 0, None
    for batch in it:
        if not batch.num_rows:
            continue
        cells = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:4]], axis=1)
        fps = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
        starts = np.flatnonzero((cells[1:] != cells[:-1]).any(1)) + 1
        if last is not None and (cells[0] != last).any():
            starts = np.concatenate([[0], starts])
        at = 0
        for s in [*starts.tolist(), len(fps)]:
            held.append(fps[at:s])
            n += s - at
            at = s
            if n >= BATCH and s < len(fps):
                yield np.concatenate(held)
                held, n = [], 0
        last = cells[-1]
    if n:
        yield np.concatenate(held)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) for every node of the edges (a, b), by alternating large and small stars."""
    seen = None
    with scratch(edges.sparkSession) as out:
        edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        for _ in range(most_rounds):
            both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
            large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
            lower = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(lower, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
            edges = saved(small)
            now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
            if now == seen:
                return out(edges.select(F.col("a").alias("node"), F.col("b").alias("root")))
            seen = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def labels(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, root (the least fingerprint), component_id (the least id reachable) for each distinct fingerprint of `fps` (id, fp)."""
    distinct = saved(fps.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(df: DataFrame, radius: int = RADIUS, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of `df` with its fingerprint (16 hex digits) and component_id, the smallest id reachable over links within `radius` bits.

    Null and empty texts have fingerprint zero and link like any other. Null ids stay; a component of null ids only has a null
    component_id. Repeated rows stay, one result row each. An empty table gives an empty result; other columns of `df` are not read.
    """
    with small_batches(df.sparkSession):
        fps = saved(fingerprints(df, k, id_col, text_col))
    return fps.join(labels(fps, radius), "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, radius: int = RADIUS, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of near duplicates one row, with all columns of `df`: the one with the least id, then the least hash of its text.

    Null ids come last. Of rows equal in id and text one stays. Links, components and winners are found on ids and
    fingerprints; texts move once, by the same sort-merge join at every size, to the rows that stay.
    """
    with small_batches(df.sparkSession):
        fps = saved(fingerprints(df, k, id_col, text_col))
    ranked = F.struct(F.col("id").isNull().alias("none"), "id", "hash")
    won = fps.join(labels(fps, radius), "fp").groupBy("root", "id", "hash").agg(F.count("*").alias("rows"))
    won = saved(won.groupBy("root").agg(F.min_by(F.struct("id", "hash", "rows"), ranked).alias("w")).select("w.*"))
    own = df.select(whole(df).alias("row"), F.col(id_col).cast("long").alias("own_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("own_hash"))
    kept = own.join(won.hint("merge"), F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash")))
    if won.where("rows > 1").isEmpty():
        return kept.select("row.*")
    return kept.where("rows = 1").select("row.*").unionByName(kept.where("rows > 1").dropDuplicates(["own_id", "own_hash"]).select("row.*"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
