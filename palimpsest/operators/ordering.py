"""Prefix scans over ordered rows that never bring all rows of a key together.

A window over a whole source would put it into one task, however long it is. Here rows of a key are cut into buckets of its order; a
window looks at one bucket only, each bucket is summarised by an aggregation that combines map-side, and a second window over
those few summaries carries what stands before (or behind) a bucket into it.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a spine, or seconds of a recording, in a bucket.
BUCKET = 4096


def bucket_of(at: Column | str, size: float = BUCKET) -> Column:
    """The bucket of a position or time; nulls share one before all others."""
    return F.coalesce(F.floor((F.col(at) if isinstance(at, str) else at) / size), F.lit(-(2**62))).cast("long")


def scan(df: DataFrame, keys: list[str], order: list[str], scans: dict[str, tuple[str, Column]], bucket: Column) -> DataFrame:
    """`df` with a column for each of `scans`: name -> (kind, value) over the other rows of its keys in the total order `order`.

    Kinds: `count` (rows before, this one included), `sum` and `max` of the rows before, `last` (the last value before that
    is not null), `next` (the first behind that is not null). `bucket` must not fall as `order` rises. Keys must not be null.
    """
    values = {f"_v{i}": v for i, (_, v) in enumerate(scans.values())}
    rows = df.withColumns({"_bucket": bucket, **values})
    at = F.struct(*order)
    own, cut = [], {}
    for i, (name, (kind, _)) in enumerate(scans.items()):
        v = F.col(f"_v{i}")
        made = {"count": F.count("*"), "sum": F.sum(v), "max": F.max(v), "last": F.max_by(v, F.when(v.isNotNull(), at)), "next": F.min_by(v, F.when(v.isNotNull(), at))}[kind]
        own.append(made.alias(f"_s{i}"))
    of_key = W.partitionBy(*keys).orderBy("_bucket")
    before, behind = of_key.rowsBetween(W.unboundedPreceding, -1), of_key.rowsBetween(1, W.unboundedFollowing)
    summary = rows.groupBy(*keys, "_bucket").agg(*own)
    carried = []
    for i, (kind, _) in enumerate(scans.values()):
        s = F.col(f"_s{i}")
        made = {"count": lambda s: F.sum(s).over(before), "sum": lambda s: F.sum(s).over(before), "max": lambda s: F.max(s).over(before), "last": lambda s: F.last(s, True).over(before), "next": lambda s: F.first(s, True).over(behind)}[kind](s)
        carried.append(made.alias(f"_c{i}"))
    rows = rows.join(summary.select(*keys, "_bucket", *carried), [*keys, "_bucket"])
    in_bucket = W.partitionBy(*keys, "_bucket").orderBy(*order)
    before, behind = in_bucket.rowsBetween(W.unboundedPreceding, -1), in_bucket.rowsBetween(1, W.unboundedFollowing)
    for i, (name, (kind, _)) in enumerate(scans.items()):
        v, c = F.col(f"_v{i}"), F.col(f"_c{i}")
        cut[name] = {
            "count": F.coalesce(c, F.lit(0)) + F.row_number().over(in_bucket),
            "sum": F.coalesce(c + F.sum(v).over(before), c, F.sum(v).over(before)),
            "max": F.greatest(c, F.max(v).over(before)),
            "last": F.coalesce(F.last(v, True).over(before), c),
            "next": F.coalesce(F.first(v, True).over(behind), c),
        }[kind]
    return rows.withColumns(cut).select(*df.columns, *cut)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, take: list[str], ties: list[str] | None = None, size: float = BUCKET) -> DataFrame:
    """`left` with the columns `take` (as one struct `found`) of the last row of `right` whose time is at or before its own; null without one.

    Of rows of `right` at one time the last by `ties` counts. Times and keys of neither side may be null. One exchange of both sides; no
    row is multiplied.
    """
    held = [c for c in left.columns if c not in keys]
    found = F.struct(*[F.col(c) for c in take])
    ties = ties or []
    kinds = dict(right.dtypes)
    none = [F.lit(None).cast(kinds[t]).alias(f"_t{i}") for i, t in enumerate(ties)]
    a = left.select(*keys, F.struct(*held).alias("_left"), F.lit(None).cast(right.select(found.alias("x")).schema[0].dataType).alias("_right"), F.col(left_at).cast("double").alias("_at"), F.lit(1).alias("_side"), *none)
    b = right.select(*keys, F.lit(None).cast(left.select(F.struct(*held).alias("x")).schema[0].dataType).alias("_left"), found.alias("_right"), F.col(right_at).cast("double").alias("_at"), F.lit(0).alias("_side"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(ties)])
    done = scan(a.unionByName(b), keys, ["_at", "_side", *[f"_t{i}" for i in range(len(ties))]], {"found": ("last", F.col("_right"))}, bucket_of("_at", size))
    return done.where("_side = 1").select(*keys, *[F.col("_left")[c].alias(c) for c in held], "found")


def equal_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of all keys."""
    return functools.reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def latest_by(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The row of each key that is greatest by `order` (nulls least); it is found by an aggregation that combines map-side. Null keys are keys."""
    rest = [c for c in df.columns if c not in keys]
    at = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("_w")).select(*keys, *[F.col("_w")[c].alias(c) for c in rest]).select(*df.columns)
