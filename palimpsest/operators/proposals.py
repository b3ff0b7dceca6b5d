"""Speaker and event proposals placed on the spine by interval and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.lineage import cut
from palimpsest.operators.intervals import overlap_join
from palimpsest.operators.ordering import as_of

KEYS = ["source_id"]


def speaker_turns(segments: DataFrame, turns: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """keys, id, speaker, overlap, coverage: who speaks most of each segment that has a text and a duration.

    Overlapped seconds are summed for each non-blank speaker; of equal sums the speaker met first (by start, end and name of a turn) counts. overlap
    and coverage (its share of the duration, 1 at most) are rounded half-even to 3 places. `turns` has turn_start, turn_end, speaker.
    """
    spoken = segments.where(~T.is_blank(F.col("text"))).select(*keys, "id", "start_time", "end_time")
    said = turns.where(~T.is_blank(F.col("speaker"))).select(*keys, "turn_start", "turn_end", "speaker")
    both = overlap_join(spoken, said, keys, ("start_time", "end_time"), ("turn_start", "turn_end"))
    seconds = F.least("end_time", "turn_end") - F.greatest("start_time", "turn_start")
    each = both.groupBy(*keys, "id", "start_time", "end_time", "speaker").agg(F.sum(seconds).alias("s"), F.min(F.struct("turn_start", "turn_end")).alias("first"))
    best = each.groupBy(*keys, "id", "start_time", "end_time").agg(F.min(F.struct((-F.col("s")).alias("less"), "first", "speaker", "s")).alias("b"))
    share = F.col("b.s") / (F.col("end_time") - F.col("start_time"))
    return best.select(*keys, "id", F.col("b.speaker").alias("speaker"), F.bround("b.s", 3).alias("overlap"), F.bround(F.least(F.lit(1.0), share), 3).alias("coverage"))


def event_proposals(segments: DataFrame, proposals: DataFrame, occupied: DataFrame | None = None, keys: list[str] = KEYS) -> DataFrame:
    """Proposals of positive length with the segment they hang on: keys, segment_id and the proposals' own columns.

    That is the last timed segment that starts at or before the proposal, or the first one. A proposal is dropped where the last occupied span that
    starts at or before its end ends after its start; only that one span is looked at.
    """
    timed = segments.where("start_time IS NOT NULL").select(*keys, F.col("id").alias("segment_id"), "start_time", "idx")
    first = timed.groupBy(*keys).agg(F.min_by("segment_id", F.struct("start_time", "idx", "segment_id")).alias("_first"))
    rows = as_of(proposals.where("end_time > start_time"), timed, keys, "start_time", "start_time", ["segment_id"], ["idx", "segment_id"])
    rows = rows.withColumn("_found", F.col("found.segment_id")).drop("found").join(first, keys)
    rows = rows.withColumn("segment_id", F.coalesce("_found", "_first")).drop("_found", "_first")
    if occupied is not None:
        spans = occupied.where("start_time IS NOT NULL AND end_time IS NOT NULL").select(*keys, F.col("start_time").alias("occupied_start"), F.col("end_time").alias("occupied_end"))
        rows = as_of(cut(rows), cut(spans), keys, "end_time", "occupied_start", ["occupied_end"], ["occupied_end"])
        rows = rows.where("found IS NULL OR found.occupied_end <= start_time").drop("found")
    return rows
