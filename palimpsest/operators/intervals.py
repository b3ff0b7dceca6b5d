"""Joins and set operations on time spans [start, end) of a key, dealt by time so that a long recording is many tasks' work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.lineage import cut
from palimpsest.operators.ordering import bucket_of, scan

#: Seconds in a bucket of the overlap join. A span stands in one bucket for each SPAN_BUCKET seconds that it covers.
SPAN_BUCKET = 64.0


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], size: float = SPAN_BUCKET) -> DataFrame:
    """Pairs of a span of `left` and one of `right` with equal keys that overlap by more than a point; both sides' columns, the keys once.

    Equi-join on keys and time bucket with the overlap as residual predicate; a pair that meets in several buckets counts in the first
    one they share. Apart from the keys, column names must differ. Spans that are empty, reversed or lack a time meet nothing.
    """
    (ls, le), (rs, re) = left_span, right_span

    def spread(df: DataFrame, s: str, e: str) -> DataFrame:
        return df.where(F.col(e) > F.col(s)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(s) / size), F.floor(F.col(e) / size))))

    both = spread(left, ls, le).join(spread(right, rs, re), [*keys, "_bucket"])
    first = F.greatest(F.floor(F.col(ls) / size), F.floor(F.col(rs) / size))
    return both.where((F.col(rs) < F.col(le)) & (F.col(re) > F.col(ls)) & (F.col("_bucket") == first)).drop("_bucket")


def gaps(spans: DataFrame, bounds: DataFrame, keys: list[str], start: str = "start_time", end: str = "end_time", bound: str = "watermark") -> DataFrame:
    """The maximal parts of [0, bound) that no span covers, for each key of `bounds` (one row for each): keys, start, end.

    Keys without a positive bound have none. Spans are clipped to the bound; a running maximum of ends finds the gaps.
    """
    known = bounds.where(F.col(bound) > 0).select(*keys, F.col(bound).alias("_w"))
    clipped = spans.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e")).join(known, keys)
    clipped = clipped.select(*keys, F.greatest("_s", F.lit(0.0)).alias("_s"), F.least("_e", "_w").alias("_e")).where("_e > _s")
    clipped = cut(clipped.groupBy(*keys, "_s").agg(F.max("_e").alias("_e")))  # one row for each start makes the order total
    seen = scan(clipped, keys, ["_s"], {"_reached": ("max", F.col("_e"))}, bucket_of("_s")).withColumn("_reached", F.coalesce("_reached", F.lit(0.0)))
    inner = seen.where("_s > _reached").select(*keys, F.col("_reached").alias(start), F.col("_s").alias(end))
    tail = known.join(clipped.groupBy(*keys).agg(F.max("_e").alias("_last")), keys, "left").withColumn("_last", F.coalesce("_last", F.lit(0.0)))
    return inner.unionByName(tail.where("_w > _last").select(*keys, F.col("_last").alias(start), F.col("_w").alias(end)))
