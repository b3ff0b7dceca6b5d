"""Annotated spans of the effective spine, negative regions, and the gated training-data fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.lineage import cut
from palimpsest.operators.intervals import gaps
from palimpsest.operators.overlay import active, created, latest_gates, overlay_spans
from palimpsest.operators.projection import effective_spine
from palimpsest.schemas import SPLIT

KEYS = ["source_id"]


def provenance(corrections: DataFrame) -> DataFrame:
    """insert_id, op_ids, session_ids: every correction that touches an insert, superseded ones too, in order of time (the insert itself counts)."""
    own = corrections.where("operation = 'chunk_insert'").select(F.col("id").alias("insert_id"))
    direct = corrections.select(F.col("payload.segment_id").alias("insert_id"), "id", "session_id", "created_at", "seq")
    edges = corrections.where("correction_type = 'timing'").select(F.explode(F.array_distinct(F.transform("payload.edits", lambda e: e["segment_id"]))).alias("insert_id"), "id", "session_id", "created_at", "seq")
    itself = corrections.where("operation = 'chunk_insert'").select(F.col("id").alias("insert_id"), "id", "session_id", "created_at", "seq")
    touches = direct.unionByName(edges).unionByName(itself).where("insert_id IS NOT NULL").join(own, "insert_id", "left_semi")
    chain = touches.groupBy("insert_id").agg(F.array_sort(F.collect_list(F.struct(created().alias("at"), "seq", "id", "session_id"))).alias("c"))
    return chain.select("insert_id", F.array_distinct(F.transform("c", lambda x: x["id"])).alias("op_ids"), F.array_sort(F.array_distinct(F.filter(F.transform("c", lambda x: x["session_id"]), lambda s: s != ""))).alias("session_ids"))


def insert_spans(effective: DataFrame, corrections: DataFrame, superseded: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """keys, insert_id, label, start_time, end_time, text, speech, session_id, session_ids, op_ids of the inserted chunks with final times; split halves are no spans."""
    meta = active(corrections.where("operation = 'chunk_insert'"), superseded).where(F.coalesce("rationale", F.lit("")) != SPLIT)
    meta = meta.select(F.col("id").alias("insert_id"), F.col("session_id"))
    rows = effective.where("is_inserted AND start_time IS NOT NULL AND end_time IS NOT NULL").withColumnRenamed("id", "insert_id").join(meta, "insert_id")
    # every insert has a row there; a left join on unique ids goes where nothing asks for its columns
    rows = rows.join(provenance(corrections), "insert_id", "left")
    return rows.select(*keys, "insert_id", "label", "start_time", "end_time", "text", (~T.is_blank(F.col("text"))).alias("speech"), "session_id", "session_ids", "op_ids")


def negative_regions(occupied: DataFrame, watermarks: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The annotated time that nothing occupies: keys, start_time, end_time."""
    return gaps(occupied, watermarks, keys)


def eligible_gates(gates: DataFrame) -> DataFrame:
    """source_id, spine, watermark of the spines whose latest gate is not 'excluded' and has a watermark."""
    latest = latest_gates(gates).where("extraction_status <> 'excluded' AND annotated_through IS NOT NULL")
    return latest.select("source_id", F.coalesce("skeleton_hash", F.lit("legacy")).alias("spine"), F.col("annotated_through").alias("watermark"), "extraction_status")


class Extraction:
    """The dataset of all eligible spines: `examples`, `skipped` (counts by reason), `speech`, `negatives`, `vocabulary`.

    `segments` has source_id and, where sources have several spines, spine (else every segment is of spine 'legacy'). Gates come first: segments of
    spines without an eligible one are never projected. `sessions` (session_id) are those whose spans count; None counts all.
    """

    def __init__(self, segments: DataFrame, corrections: DataFrame, superseded: DataFrame, gates: DataFrame, sessions: DataFrame | None = None) -> None:
        keys = ["source_id", "spine"]
        if "spine" not in segments.columns:
            segments = segments.withColumn("spine", F.lit("legacy"))
        self.gates = cut(eligible_gates(gates))
        open_ = segments.join(self.gates.select(*keys), keys, "left_semi")
        own = corrections.join(self.gates.select("source_id").distinct(), "source_id", "left_semi")
        self.effective = cut(effective_spine(open_, own, superseded, keys))
        spans = cut(insert_spans(self.effective, own, superseded, keys)).join(self.gates.select(*keys, "watermark"), keys)
        overlays = overlay_spans(own, superseded).join(open_.select(*keys, F.col("id").alias("segment_id")), ["source_id", "segment_id"]).join(self.gates.select(*keys, "watermark"), keys)
        counted = F.lit(True)
        if sessions is not None:
            known = sessions.select("session_id", F.lit(True).alias("_known")).distinct()
            spans, overlays = spans.join(known, "session_id", "left"), overlays.join(known, "session_id", "left")
            counted = F.coalesce("_known", F.lit(False))
        late = F.col("start_time") >= F.col("watermark")
        reason = F.when(F.coalesce("label", F.lit("")) == "", "unlabeled").when(late, "above_watermark").when(~counted, "session_purpose")
        over = F.when(late, "overlay_above_watermark").when(~counted, "overlay_session_purpose")
        shape = [*keys, "kind", "event_id", "label", "start_time", "end_time", "text", "speech", "session_ids", "op_ids", "segment_id", "skip_reason"]
        rows = spans.withColumns({"kind": F.lit("insert"), "event_id": F.col("insert_id"), "segment_id": F.lit(None).cast("string"), "skip_reason": reason}).select(*shape)
        rows = rows.unionByName(overlays.withColumns({"kind": F.lit("overlay"), "event_id": F.col("overlay_id"), "speech": F.lit(True), "session_ids": F.array_compact(F.array("session_id")), "skip_reason": over}).select(*shape))
        self.spans = rows
        self.examples = rows.where("skip_reason IS NULL").drop("skip_reason")
        self.skipped = rows.where("skip_reason IS NOT NULL").groupBy("skip_reason").agg(F.count("*").alias("n"))
        said = self.effective.where(~T.is_blank(F.col("text"))).join(self.gates.select(*keys, "watermark"), keys)
        said = said.where("start_time < watermark AND end_time > start_time")
        self.speech = said.select(*keys, "id", "start_time", F.least("end_time", "watermark").alias("end_time"), "text")
        occupied = spans.select(*keys, "start_time", "end_time").unionByName(self.speech.select(*keys, "start_time", "end_time"))
        self.negatives = negative_regions(occupied, self.gates.select(*keys, "watermark"), keys)
        self.vocabulary = self.examples.groupBy("label").agg(F.count("*").alias("n"))


def foreign_overlays(overlays: DataFrame, segments: DataFrame) -> DataFrame:
    """Overlays whose anchor segment is in none of `segments`."""
    return overlays.join(segments.select("source_id", F.col("id").alias("segment_id")), ["source_id", "segment_id"], "left_anti")
