"""One source's spine as an editor works on it: its tables, what a gesture adds to them, and what is shown.

A view is a value. `after(batch)` is the view once that batch is committed, without reading the workspace again: its rows are appended to the
view's own, and everything shown follows from them. So what an editor sees between two loads is what the next load will show, for every gesture.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import overlay, planners, projection, proposals, selectors, spans
from palimpsest.operators.writers import Batch, Row
from palimpsest.plans import commands
from palimpsest.sources import readers
from palimpsest.sources.store import load_tables, rows_of


@dataclass(frozen=True)
class SpineView:
    """The tables of one source. `turns`, `proposals` and `audio` may be missing."""

    spark: SparkSession
    source_id: str
    title: str
    segments: DataFrame
    corrections: DataFrame
    superseded: DataFrame
    gates: DataFrame
    turns: DataFrame | None = None
    proposals: DataFrame | None = None
    audio: DataFrame | None = None
    path: str | None = None
    skeleton_hash: str | None = None
    show_tier2: bool = False
    added: tuple[Batch, ...] = field(default=())

    @classmethod
    def open(cls, spark: SparkSession, root: str, source: str | None = None, rendition: str | None = None, skeleton: str | None = None) -> SpineView:
        """The view of the one source that `source` names by id or part of its title; ValueError where that is none or several."""
        tables = load_tables(spark, root)
        found = selectors.match_sources(tables["source"], source).orderBy("id").limit(3).collect()
        if len(found) != 1:
            raise ValueError(f"{source!r} names {'several sources' if found else 'no source'}: {[r['title'] for r in found]}")
        return cls.load(spark, root, found[0]["id"], found[0]["title"], rendition, skeleton, tables)

    @classmethod
    def load(cls, spark: SparkSession, root: str, source_id: str, title: str = "", rendition: str | None = None, skeleton: str | None = None, tables: dict[str, DataFrame] | None = None) -> SpineView:
        """The view of a source that is known by its id."""
        tables = tables or load_tables(spark, root)
        segments = commands.one_spine(tables, source_id, rendition, skeleton).where(F.col("source_id") == source_id)
        own = lambda t: tables[t].where(F.col("source_id") == source_id)
        found = readers.find_proposal_set(spark, root, source_id=source_id)
        media, first = tables["source"].where(F.col("id") == source_id).first(), segments.select("skeleton_hash").first()
        renditions = tables["audio_rendition"].where("model_input_path IS NOT NULL").groupBy(F.col("audio_segment_id").alias("id")).agg(F.min("model_input_path").alias("wav_path"))
        audio = own("audio_segment").join(renditions, "id", "left")
        return cls(spark, source_id, title, segments, own("correction"), commands.superseded_of(tables), own("gate"), own("turn"), found and found[1], audio, media and media["path"], first and first[0])

    # ---- what is shown

    @property
    def frame(self) -> DataFrame:
        """All rows in order, pruned ones in place, with is_pruned, is_marked, mark_classes, has_overlay, entity_id, split_group."""
        return commands.spine_view(self.segments, self.corrections, self.superseded)

    @property
    def size(self) -> int:
        return self.frame.count()

    def window(self, cursor: int, count: int) -> DataFrame:
        at = self.spark.range(1).select(F.lit(self.source_id).alias("source_id"), F.lit(cursor).alias("cursor"))
        return planners.cursor_window(self.frame, at, count)

    @property
    def active(self) -> DataFrame:
        return overlay.active(self.corrections, self.superseded)

    def prune_for(self, segment_id: str) -> DataFrame:
        """The first active prune that takes a segment away: what an unprune amends."""
        held = self.active.where("operation = 'prune_empty'").where(F.array_contains("payload.pruned_segment_ids", segment_id))
        return held.orderBy("created_at", "seq", "id").limit(1)

    def marks_for(self, segment_id: str) -> DataFrame:
        """Open marks on a segment, the oldest first; marks whose anchor lacks something are on none."""
        from palimpsest.operators.bulk import anchored

        return overlay.open_marks(self.corrections, self.superseded).where(F.array_contains(anchored(F.col("payload.anchor")), segment_id)).orderBy("created_at", "seq")

    @property
    def seen_mark_classes(self) -> list[str]:
        return self._seen(overlay.open_marks(self.corrections, self.superseded), "mark_class")

    @property
    def overlays(self) -> DataFrame:
        return overlay.speech_overlays(self.corrections, self.superseded)

    def overlays_for(self, segment_id: str) -> DataFrame:
        """Active speech overlays of a segment, the oldest first."""
        return self.overlays.where(F.col("payload.anchor.segment_id") == segment_id).orderBy("created_at", "seq")

    @property
    def overlay_count(self) -> int:
        return self.overlays.count()

    @property
    def seen_overlay_labels(self) -> list[str]:
        return self._seen(self.overlays, "label")

    @property
    def seen_insert_labels(self) -> list[str]:
        """Labels of the inserts that stand in this spine."""
        return [r[0] for r in self.frame.where("is_inserted AND label <> ''").select("label").distinct().orderBy("label").collect()]  # one row a class

    def _seen(self, rows: DataFrame, name: str) -> list[str]:
        label = F.col(f"payload.{name}").alias("label")
        return [r[0] for r in rows.select(label).where("label <> ''").distinct().orderBy("label").collect()]  # one row a class

    @property
    def speakers(self) -> DataFrame:
        return overlay.assignments(self.corrections, self.superseded)

    @property
    def cluster_entities(self) -> DataFrame:
        """cluster, entity_id: who a diarization cluster was last said to be."""
        rows = self.speakers.where("cluster IS NOT NULL").join(self.corrections.select(F.col("id").alias("correction_id"), "created_at", "seq"), "correction_id")
        return rows.groupBy("cluster").agg(F.max_by("entity_id", F.struct("created_at", "seq")).alias("entity_id"))

    @property
    def gate(self) -> Row | None:
        """The live gate of this spine; None is one in progress."""
        own = overlay.latest_gates(self.gates.where(F.col("skeleton_hash").eqNullSafe(self.skeleton_hash))).first()
        return own and own.asDict()

    @property
    def chunks(self) -> DataFrame:
        """wav_path, start_s, end_s of each row within its audio segment."""
        if self.audio is None:
            raise ValueError("the view has no audio")
        return planners.audio_chunks(self.frame, self.audio)

    @property
    def seams(self) -> DataFrame:
        return planners.seams(self.frame)

    @property
    def event_proposals(self) -> DataFrame | None:
        """Pending proposals by segment: those that no labelled insert lies on, and of tier 2 only if it is shown."""
        if self.proposals is None:
            return None
        frame = self.frame
        taken = frame.where("is_inserted AND label <> ''")
        return proposals.event_proposals(frame, self.proposals if self.show_tier2 else self.proposals.where("coalesce(tier, 1) = 1"), taken)

    def turn_proposals(self, segment_id: str | None = None) -> DataFrame | None:
        """Who speaks most of each row by the diarization, or of one."""
        if self.turns is None:
            return None
        frame = self.frame if segment_id is None else self.frame.where(F.col("id") == segment_id)
        return proposals.speaker_turns(frame, self.turns)

    @property
    def insert_spans(self) -> DataFrame:
        return spans.insert_spans(projection.effective_spine(self.segments, self.corrections, self.superseded), self.corrections, self.superseded)

    # ---- what a gesture adds

    def after(self, *batches: Batch) -> SpineView:
        """The view once these batches of writers are committed: unprunes, speakers, marks, overlays, gates, inserts, splits, texts, times, and what takes them back."""
        made = self
        for batch in batches:
            rows = batch.rows
            dead = [(e["target_id"],) for e in rows.get("edge", []) if e["relation_type"] == "SUPERSEDES"]
            made = replace(
                made,
                corrections=made._with("correction", made.corrections, rows.get("correction")),
                gates=made._with("gate", made.gates, rows.get("gate")),
                superseded=made.superseded.union(self.spark.createDataFrame(dead, "target_id string")).distinct() if dead else made.superseded,
                added=(*made.added, batch),
            )
        return made

    def _with(self, table: str, held: DataFrame, rows: list[dict[str, Any]] | None) -> DataFrame:
        own = [r for r in rows or () if r.get("source_id") == self.source_id]
        return held.unionByName(rows_of(self.spark, table, own)) if own else held

    def with_tier2(self, shown: bool = True) -> SpineView:
        return replace(self, show_tier2=shown)
