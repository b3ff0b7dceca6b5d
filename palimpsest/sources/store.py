"""Tables of a workspace as Parquet folders, append-only, with a change log of JSON lines beside them."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.writers import Batch
from palimpsest.schemas import TABLES, schema


def load_table(spark: SparkSession, root: str, name: str, days: list[int] | None = None) -> DataFrame:
    """One table of a workspace, or some days of it; an empty one where nothing has been written yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return spark.createDataFrame([], schema(name))
    rows = spark.read.schema(T.StructType([*schema(name), T.StructField("day", T.LongType())]) if "seq" in schema(name).names else schema(name)).parquet(f"{root}/{name}")
    if days is not None:
        rows = rows.where(F.coalesce("day", F.lit(0)).isin(days))
    return rows.drop("day")


def load_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: load_table(spark, root, name) for name in TABLES if name != "journal"}


def rows_of(spark: SparkSession, name: str, rows: list[dict[str, Any]]) -> DataFrame:
    """Dicts as rows of a table; what they lack is null."""
    return spark.createDataFrame([(json.dumps(r, ensure_ascii=False),) for r in rows], "value string").select(F.from_json("value", schema(name)).alias("r")).select("r.*")


def fresh_rows(rows: DataFrame, there: DataFrame, key: list[str]) -> DataFrame:
    """Each new key of `rows` once; what is `there` is left out."""
    return rows.dropDuplicates(key).join(there.select(*key), key, "left_anti").select(*rows.columns)


#: Tables that grow by commits are partitioned by the day of seq, in nanoseconds. A row that comes again has the seq it had, so only the days of a batch are looked through.
DAY = 86_400_000_000_000


class OverlayStore:
    """Appends batches of a workspace at `root`: rows whose id is there already are left out, so a batch may come twice.

    Writers that append one and the same row at the same moment may both do so; batches of different writers never share ids.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return load_table(self.spark, self.root, name)

    def append(self, name: str, rows: DataFrame, key: list[str] | None = None) -> None:
        """Rows with a new key. Sessions and entities are change rows: their key is id and seq; tables without ids are told apart by all their columns."""
        fields = schema(name).fieldNames()
        key = key or (["id", "seq"] if name in ("session", "entity") else ["id"] if "id" in fields else fields)
        path, names = f"{self.root}/{name}", fields
        if "seq" not in names:
            fresh_rows(rows.select(*names), self.table(name), key).write.mode("append").parquet(path)
            return
        rows = rows.select(*names, F.expr(f"coalesce(seq, 0L) div {DAY}L").alias("day"))
        days = [r[0] for r in rows.select("day").distinct().collect()]  # of one batch
        there = load_table(self.spark, self.root, name, days)
        fresh_rows(rows, there, key).write.mode("append").partitionBy("day").parquet(path)

    def commit(self, batch: Batch, anchor: dict | None = None) -> Batch:
        """All rows of a batch - corrections last, so that what they refer to is there - and a line in the change log."""
        for name in sorted(batch.rows, key=lambda n: n == "correction"):
            if batch.rows[name]:
                self.append(name, rows_of(self.spark, name, batch.rows[name]))
        line = {"verb": batch.verb, "actor": batch.actor, "set": batch.session_id, "args": batch.args, "wires": batch.rows}
        if batch.rows.get("correction"):
            line["id"] = batch.id
        if anchor:
            line["anchor"] = anchor
        self.spark.createDataFrame([(json.dumps(line, ensure_ascii=False),)], "value string").coalesce(1).write.mode("append").text(f"{self.root}/journal")
        return batch
