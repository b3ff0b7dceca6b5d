"""Reading the overlay: supersession, latest-wins folds, marks, assignments, gates, review markers, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.ordering import latest_by
from palimpsest.schemas import GENUINE, SPLIT_PREFIX


def superseded_ids(edges: DataFrame) -> DataFrame:
    """target_id of every SUPERSEDES edge. A superseded superseder still supersedes: nothing is revived."""
    return edges.where("relation_type = 'SUPERSEDES' AND target_id IS NOT NULL").select("target_id").distinct()


def active(corrections: DataFrame, superseded: DataFrame | None) -> DataFrame:
    """Corrections that no other one supersedes, whatever their status. `superseded` has a column target_id; None: these are active already."""
    if superseded is None:
        return corrections
    return corrections.join(superseded.select("target_id"), F.col("id") == F.col("target_id"), "left_anti")


def flag_superseded(corrections: DataFrame, superseded: DataFrame) -> DataFrame:
    """All corrections with a boolean is_superseded."""
    targets = superseded.select(F.col("target_id").alias("_target")).distinct()
    return corrections.join(targets, F.col("id") == F.col("_target"), "left").withColumn("is_superseded", F.col("_target").isNotNull()).drop("_target")


def open_marks(corrections: DataFrame, superseded: DataFrame) -> DataFrame:
    return active(corrections.where("correction_type = 'mark' AND operation = 'mark'"), superseded)


def speech_overlays(corrections: DataFrame, superseded: DataFrame) -> DataFrame:
    return active(corrections.where("correction_type = 'annotation' AND operation = 'speech_overlay'"), superseded)


def overlay_spans(corrections: DataFrame, superseded: DataFrame) -> DataFrame:
    """Active speech overlays as flat spans; those without both times drop out."""
    p = F.col("payload")
    return (
        speech_overlays(corrections, superseded)
        .where(p["start_time"].isNotNull() & p["end_time"].isNotNull())
        .select(
            "source_id",
            F.col("id").alias("overlay_id"),
            p["anchor"]["segment_id"].alias("segment_id"),
            p["label"].alias("label"),
            p["text"].alias("text"),
            p["start_time"].alias("start_time"),
            p["end_time"].alias("end_time"),
            p["anchor"]["char_start"].alias("char_start"),
            p["anchor"]["char_end"].alias("char_end"),
            p["snap"].alias("snap"),
            p["words"].alias("words"),
            "session_id",
            F.array("id").alias("op_ids"),
        )
    )


def split_groups(corrections: DataFrame) -> DataFrame:
    """insert_id, member_id: the text and timing corrections that were made with a chunk split."""
    return corrections.where(F.col("rationale").startswith(SPLIT_PREFIX)).select(F.substring(F.col("rationale"), F.lit(len(SPLIT_PREFIX) + 1), F.length("rationale")).alias("insert_id"), F.col("id").alias("member_id"))


def created(name: str = "created_at"):
    return F.coalesce(F.col(name), F.lit(0.0))


def latest_texts(corrections: DataFrame, superseded: DataFrame | None, segments: DataFrame | None = None) -> DataFrame:
    """The newest active text correction of each segment (of `segments`, if given), whatever its status; of equally new ones the first read counts."""
    rows = active(corrections.where("correction_type = 'text_content'"), superseded)
    rows = rows.withColumn("segment_id", F.col("payload.segment_id")).where("segment_id IS NOT NULL")
    if segments is not None:
        rows = rows.join(segments.select(F.col("id").alias("segment_id")), "segment_id", "left_semi")
    return latest_by(rows, ["segment_id"], [created(), -F.col("seq")])


def assignments(corrections: DataFrame, superseded: DataFrame) -> DataFrame:
    """The newest active speaker assignment of each segment: segment_id, entity_id, verdict, correction_id, cluster."""
    rows = active(corrections.where("correction_type = 'speaker' AND operation = 'speaker_assign'"), superseded)
    rows = rows.select("source_id", F.explode("payload.segment_ids").alias("segment_id"), F.col("payload.entity_id").alias("entity_id"), F.col("payload.verdict").alias("verdict"), F.col("id").alias("correction_id"), F.col("payload.proposal").getItem("cluster").alias("cluster"), "created_at", "seq")
    return latest_by(rows, ["segment_id"], [created(), "seq"]).drop("created_at", "seq")


def review_markers(edges: DataFrame, session_id: str | None = None) -> DataFrame:
    """session_id, segment_id, decision: the latest decision of each; one that is 'unreviewed' at last leaves none. Edges start at their session."""
    rows = edges.where("relation_type = 'REVIEWED'")
    if session_id is not None:
        rows = rows.where(F.col("source_id") == session_id)
    rows = rows.select(F.col("source_id").alias("session_id"), F.col("target_id").alias("segment_id"), "decision", F.coalesce("ts", F.lit(0.0)).alias("ts"), "seq")
    return latest_by(rows, ["session_id", "segment_id"], ["ts", "seq"]).where("decision IS NULL OR decision <> 'unreviewed'").select("session_id", "segment_id", "decision")


def latest_gates(gates: DataFrame) -> DataFrame:
    """The latest gate of each spine; a null skeleton hash is a spine of its own, and of equally late ones the last read counts."""
    return latest_by(gates, ["source_id", "skeleton_hash"], [created(), "seq"])


def session_purposes(sessions: DataFrame) -> DataFrame:
    """source_id, purpose, n over the sessions' scopes; a blank purpose is genuine work."""
    purpose = F.coalesce(F.nullif(F.trim("purpose"), F.lit("")), F.lit(GENUINE))
    return sessions.select(F.explode("scope").alias("source_id"), purpose.alias("purpose")).groupBy("source_id", "purpose").agg(F.count("*").alias("n"))


def sessions_for(sessions: DataFrame, purposes: list[str] | None) -> DataFrame:
    """session_id of the sessions whose purpose is among `purposes` (all if None)."""
    purpose = F.coalesce(F.nullif(F.trim("purpose"), F.lit("")), F.lit(GENUINE))
    return (sessions if purposes is None else sessions.where(purpose.isin(list(purposes)))).select(F.col("id").alias("session_id"))


def latest_rows(changes: DataFrame, keys: list[str] | None = None, at: str = "updated_at") -> DataFrame:
    """Mutable metadata as the latest row of each id: session status and purpose, entity names."""
    return latest_by(changes, keys or ["id"], [F.coalesce(F.col(at), F.lit(0.0)), F.col("seq")])


def speaker_entities(entities: DataFrame, kind: str | None = "person") -> DataFrame:
    """The registry, one row an entity, with a sort key: names in lower case, null as ''."""
    rows = latest_rows(entities)
    rows = rows if kind is None else rows.where(F.col("kind") == kind)
    return rows.withColumn("sort_name", F.lower(F.coalesce("canonical_name", F.lit(""))))


def prior_by_hash(corrections: DataFrame, edges: DataFrame, segments: DataFrame, content_hash: str | None = None) -> DataFrame:
    """content_hash and every correction of a segment that carries it, superseded ones too: what was done to the same audio elsewhere."""
    held = segments.select(F.col("id").alias("_segment"), F.explode(F.array_distinct(F.concat(F.array("content_hash"), F.coalesce(F.transform("text_slices", lambda s: s["content_hash"]), F.array().cast("array<string>"))))).alias("content_hash")).where("content_hash IS NOT NULL")
    if content_hash is not None:
        held = held.where(F.col("content_hash") == content_hash)
    on = edges.where("relation_type = 'CORRECTS'").select(F.col("source_id").alias("_correction"), F.col("target_id").alias("_segment"))
    touched = on.join(held, "_segment").select("_correction", "content_hash").distinct()
    return corrections.join(touched, F.col("id") == F.col("_correction")).drop("_correction")
