"""Counts over the overlay and over sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.overlay import active, open_marks
from palimpsest.schemas import GENUINE, SPLIT


def correction_stats(corrections: DataFrame, superseded: DataFrame, by: list[str] | None = None) -> DataFrame:
    """source_id (and the columns `by`), kind, name, n, in one pass over the active corrections.

    Kinds: active (name ''), op (correction_type), insert_label ('(unlabeled)' where blank; without split halves), splits, open_marks, mark_class ('?' where blank).
    Supersession is global; a scope of sessions is for the caller to filter.
    """
    rows = active(corrections, superseded)
    p = F.col("payload")
    inserted = F.coalesce(F.col("operation") == "chunk_insert", F.lit(False))
    split = F.coalesce(F.col("rationale") == SPLIT, F.lit(False))
    marked = F.coalesce((F.col("correction_type") == "mark") & (F.col("operation") == "mark"), F.lit(False))
    pair = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    facts = F.array(
        pair("active", F.lit("")),
        pair("op", F.coalesce("correction_type", F.lit("?"))),
        F.when(inserted & ~split, pair("insert_label", F.coalesce(F.nullif(p["label"], F.lit("")), F.lit("(unlabeled)")))),
        F.when(inserted & split, pair("splits", F.lit(""))),
        F.when(marked, pair("open_marks", F.lit(""))),
        F.when(marked, pair("mark_class", F.coalesce(F.nullif(p["mark_class"], F.lit("")), F.lit("?")))),
    )
    keys = ["source_id", *(by or [])]
    return rows.select(*keys, F.explode(F.array_compact(facts)).alias("x")).groupBy(*keys, F.col("x.kind").alias("kind"), F.col("x.name").alias("name")).agg(F.count("*").alias("n"))


def stats_by_purpose(corrections: DataFrame, superseded: DataFrame, sessions: DataFrame, purposes: list[str] | None = None) -> DataFrame:
    """correction_stats() for each purpose of a session; sessions that are unknown or have a blank purpose are genuine. `purposes` cuts counts, not supersession."""
    purpose = sessions.select(F.col("id").alias("session_id"), F.coalesce(F.nullif(F.trim("purpose"), F.lit("")), F.lit(GENUINE)).alias("purpose"))
    rows = corrections.join(purpose, "session_id", "left").withColumn("purpose", F.coalesce("purpose", F.lit(GENUINE)))
    if purposes is not None:
        rows = rows.where(F.col("purpose").isin(list(purposes)))
    return correction_stats(rows, superseded, ["purpose"])


def label_spotlight(corrections: DataFrame, superseded: DataFrame, label: str) -> DataFrame:
    """source_id, inserts, marks with this label or class among the active corrections."""
    rows = active(corrections, superseded)
    return rows.groupBy("source_id").agg(
        F.count_if((F.col("operation") == "chunk_insert") & (F.col("payload.label") == label)).alias("inserts"),
        F.count_if((F.col("operation") == "mark") & (F.col("payload.mark_class") == label)).alias("marks"),
    )


def source_status(sources: DataFrame, audio: DataFrame, corrections: DataFrame, superseded: DataFrame) -> DataFrame:
    """id, audio_segments, active, open_marks for every source."""
    coarse = audio.groupBy("source_id").agg(F.count("*").alias("audio_segments"))
    live = active(corrections, superseded).groupBy("source_id").agg(F.count("*").alias("active"))
    marks = open_marks(corrections, superseded).groupBy("source_id").agg(F.count("*").alias("open_marks"))
    out = sources.select("id")
    for part in (coarse, live, marks):
        out = out.join(part, F.col("id") == F.col("source_id"), "left").drop("source_id")
    return out.fillna(0, ["audio_segments", "active", "open_marks"])


def spine_counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("source_id").agg(F.count("*").alias("segments"))


def run_summary(segments: DataFrame, flagged: DataFrame, effective: DataFrame, pruned: DataFrame) -> DataFrame:
    """source_id, segments, empty_segments, flagged, pruned, effective_segments. `pruned` has source_id and id."""
    from palimpsest.functions.text import is_blank

    out = segments.groupBy("source_id").agg(F.count("*").alias("segments"), F.count_if(is_blank(F.col("text"))).alias("empty_segments"))
    for name, part in (("flagged", flagged.where(F.size("flags") > 0)), ("pruned", pruned), ("effective_segments", effective)):
        out = out.join(part.groupBy("source_id").agg(F.count("*").alias(name)), "source_id", "left")
    return out.fillna(0, ["flagged", "pruned", "effective_segments"])
