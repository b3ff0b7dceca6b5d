"""What the training-data operators share: reading tables, words, and saving intermediate tables."""

from __future__ import annotations

import contextlib
import string
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import lineage
from palimpsest.lineage import cut as saved
from palimpsest.lineage import remove, scratch, shared_folder

__all__ = ["LOWER", "UPPER", "batches", "dealt_join", "folded_words", "lower_ascii", "on_path", "quoted", "remove", "saved", "scratch", "shared_folder", "small_batches", "small_side", "table", "whole", "words"]
MOST_BROADCAST = 50_000
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def on_path(spark: SparkSession) -> None:
    """Let Python workers find this package, and get whole texts in batches of 2,000 rows, if the session has not chosen another size than Spark's 10,000."""
    lineage.on_path(spark)
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "2000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    on_path(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(col, UPPER, LOWER)


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8 (bytes.split() splits at just these six); null has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def folded_words(text: str | None) -> list[bytes]:
    """As words(), with A-Z lower-cased (bytes.lower() touches nothing else)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 8192, size_bytes: int = 16 << 20, weigh: int | None = None) -> Iterator[pa.RecordBatch]:
    """Record batches of at most `size` rows; `weigh` names a column of str or bytes whose lengths may end a batch sooner."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        if weigh is not None:
            weight += len(row[weigh] or b"")
        if len(held) >= size or weight >= size_bytes:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole(df: DataFrame, without: Iterable[str] = ()) -> Column:
    """All columns of `df` but some as one struct, so that no name of theirs meets a name of ours."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns if c not in without])


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """What is written inside goes to Python in Arrow batches of `rows` rows at most: with whole texts in them, the default of 10,000 takes some 100 MB of each task, outside the heap."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def small_side(written: DataFrame) -> DataFrame:
    """A written table for a join: to broadcast up to MOST_BROADCAST rows of a few numbers, which are a few MB, and to shuffle beyond."""
    return F.broadcast(written) if written.count() <= MOST_BROADCAST else written


def dealt_join(left: DataFrame, right: DataFrame, owner: list[str], by: list[str], most: int, counted: DataFrame | None = None, rows: str | None = None) -> DataFrame:
    """Inner join on `owner`, of which `right` has one row each. An owner with more than `most` rows of `left` is dealt in parts by `by`, with a copy of its row for each part.

    `counted` has the same owners as often as `left` and is cheaper to read; `rows` names a column of `right` that has the counts already.
    """
    n, part = "n of parts", "part of them"
    if rows is None:
        told = (counted or left).groupBy(*owner).agg(F.count("*").alias(n))
    else:
        told = right.select(*owner, F.col(rows).alias(n))
    often = saved(told.select(*owner, F.ceil(F.col(n) / most).cast("int").alias(n)).where(F.col(n) > 1))
    if often.isEmpty():
        return left.join(right, owner)
    often = small_side(often)
    parts = F.coalesce(F.col(n), F.lit(1))
    dealt = left.join(often, owner, "left").withColumn(part, F.pmod(F.xxhash64(*by), parts).cast("int")).drop(n)
    copies = right.join(often, owner, "left").withColumn(part, F.explode(F.sequence(F.lit(0), parts - 1))).drop(n)
    return dealt.join(copies, [*owner, part]).drop(part)
