"""Proportional stratified interleaving: deal rows into shards that all match the mixture of sources.

Rows get a seeded order within their source, hence a fractional rank (rank - 1/2) / rows of the source. All rows
sorted by that fraction and cut into equal runs give shards in which every source has its share.

No window ever holds a whole source: an order key is first cut into buckets, as many as keep one at some BUCKET_ROWS rows, the buckets are counted
(with map-side sums), running sums of those few counts give what lies before a bucket, and only the rank inside a bucket
needs its rows together. A source with a third of all rows is dealt over as many buckets as any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import table

#: Buckets of the seeded order within a source and of the fraction over all rows are powers of two, these at least.
SOURCE_BITS, FRACTION_BITS, BUCKET_ROWS = 10, 12, 50_000


def interleave(df: DataFrame, shards: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Deal every row of `df` into `shards` shards whose row counts differ by one at most (law `rows`).

    Returns id, size (UTF-8 bytes plus 1), text_crc32, law, shard (from 0), slot (gapless from 0 in each shard), grown_shard
    (always null: this law has no growth rule), source and fraction. Null texts count as empty; null sources are a source of their own; null and
    repeated ids are rows like any other; rows that are equal in id and text take neighbouring places. An empty table gives
    an empty result. Other columns of `df`, whatever their names, are not read.
    """
    wanted = math.ceil(math.log2(max(1, df.count()) / BUCKET_ROWS))
    source_bits, cells = max(SOURCE_BITS, wanted), 1 << max(FRACTION_BITS, wanted)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("crc"),
        F.col(source_col).alias("source"),
        F.when(F.col(source_col).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(source_col).cast("string"))).alias("stratum"),
    ).withColumn("h", F.xxhash64(F.lit(seed), "id", "crc", "size"))
    rows = rows.withColumn("part", F.shiftrightunsigned("h", 64 - source_bits).cast("int"))
    order = ["h", "id", "crc", "size"]

    counted = rows.groupBy("stratum", "part").agg(F.count("*").alias("n"))
    of = W.partitionBy("stratum")
    before = counted.select("stratum", "part", (F.sum("n").over(of.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(of).alias("rows"))
    ranked = rows.withColumn("place", F.row_number().over(W.partitionBy("stratum", "part").orderBy(*order))).join(before, ["stratum", "part"])
    ranked = ranked.withColumn("fraction", (F.col("before") + F.col("place") - 0.5) / F.col("rows")).drop("before", "place", "rows", "part")

    ranked = ranked.withColumn("cell", F.floor(F.col("fraction") * cells).cast("int"))
    counted = ranked.groupBy("cell").agg(F.count("*").alias("n"))
    every = W.orderBy("cell")  # over one row for each bucket
    first = counted.select("cell", (F.sum("n").over(every) - F.col("n")).alias("first"), F.sum("n").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"))
    placed = ranked.withColumn("place", F.row_number().over(W.partitionBy("cell").orderBy("fraction", *order))).join(first, "cell")
    placed = placed.withColumn("at", F.col("first") + F.col("place") - 1)
    shard = F.expr(f"(at * {int(shards)}) div total")
    return placed.withColumn("shard", shard).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("at") - F.expr(f"(shard * total + {int(shards) - 1}) div {int(shards)}")).cast("long").alias("slot"),
        _null_int().alias("grown_shard"),
        "source",
        "fraction",
    )


def _null_int() -> Column:
    return F.lit(None).cast("int")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7."""
    return interleave(table(spark, sf_dir, "documents"))
