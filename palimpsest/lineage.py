"""Cutting lineage: intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []
_swept: set[str] = set()


def on_path(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver has it (a cluster that ships it as a file finds it anyway)."""
    root = str(Path(__file__).resolve().parents[1])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def shared_folder(spark: SparkSession) -> str:
    """This application's part of the session's spark.checkpoint.dir. What is left in it goes when the driver ends.

    Where that setting is missing, a session in one process takes a folder below /tmp; on a cluster executors would each write to a disk of their own, so that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder and context.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"{(folder or '/tmp').rstrip('/')}/palimpsest-{context.applicationId}"
    if own not in _swept:
        _swept.add(own)
        atexit.register(_delete, *_place(spark, own))
    return own


def _place(spark: SparkSession, path: str) -> tuple:
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration()


def _delete(path, conf) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone, and then there is nobody to ask
        path.getFileSystem(conf).delete(path, True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is; one that does not exist is fine."""
    _delete(*_place(spark, path))


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are cut inside are deleted at the end. What is to leave goes through the function that this gives: it is cut and outlives them."""
    _scopes.append([])

    def out(df: DataFrame) -> DataFrame:
        own = _scopes.pop()
        try:
            return cut(df, again=True)
        finally:
            _scopes.append(own)

    try:
        yield out
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def cut(df: DataFrame, again: bool = False) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back: what stands on it several times is computed once, and a lost executor costs no more than the last stage.

    A table that this made is one already and is given back as it is, unless `again` is set.
    """
    if getattr(df, "_is_cut", False) and not again:
        return df
    spark = df.sparkSession
    on_path(spark)
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._is_cut = True
    return table
