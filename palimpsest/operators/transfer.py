"""Event inserts without words move between spines of one source; words that an alignment put into the wrong chunk are found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.lineage import cut
from palimpsest.operators.intervals import gaps, overlap_join
from palimpsest.operators.ordering import as_of, bucket_of, scan
from palimpsest.operators.signals import with_next

KEYS = ["source_id"]
# fixed values
SLACK, UNCOVERED = 0.02, 0.5


def labelled_units(effective: DataFrame, labels: list[str] | None = None) -> DataFrame:
    rows = effective.where("is_inserted AND label <> ''")
    return rows if labels is None else rows.where(F.col("label").isin(list(labels)))


def wordless_donors(effective: DataFrame, labels: list[str] | None = None, keys: list[str] = KEYS) -> DataFrame:
    """keys, insert_id, label, start_time, end_time, rank of labelled, timed inserts without words."""
    rows = labelled_units(effective, labels).where(T.is_blank(F.col("text")))
    return rows.where("start_time IS NOT NULL AND end_time IS NOT NULL").select(*keys, F.col("id").alias("insert_id"), "label", "start_time", "end_time", "rank")


def word_bearing(effective: DataFrame, labels: list[str] | None = None, keys: list[str] = KEYS) -> DataFrame:
    """keys, n: labelled inserts that have words and so stay with their spine."""
    return labelled_units(effective, labels).where(~T.is_blank(F.col("text"))).groupBy(*keys).agg(F.count("*").alias("n"))


def transfer_plan(donors: DataFrame, effective_to: DataFrame, segments_to: DataFrame, tolerance: float = 0.15, keys: list[str] = KEYS) -> DataFrame:
    """Donors with status ('transfer', 'duplicate', 'unanchored'), after_id and before_id on the other spine.

    A duplicate has an insert with its label there that starts within `tolerance`. The anchor is the last segment that starts at or before the donor.
    """
    size = max(tolerance, 1e-3) * 8
    there = labelled_units(effective_to).where("start_time IS NOT NULL").select(*keys, F.col("label").alias("_label"), F.col("start_time").alias("_start"))
    there = there.withColumn("_cell", F.explode(F.sequence(F.floor((F.col("_start") - tolerance) / size), F.floor((F.col("_start") + tolerance) / size))))
    cells = cut(donors).withColumn("_cell", F.floor(F.col("start_time") / size))
    on = [cells[k] == there[k] for k in keys] + [F.col("label") == F.col("_label"), cells["_cell"] == there["_cell"], F.abs(F.col("_start") - F.col("start_time")) <= tolerance]
    twice = cells.join(there, on, "left_semi").drop("_cell").withColumns({"status": F.lit("duplicate"), "after_id": F.lit(None).cast("string"), "before_id": F.lit(None).cast("string")})
    once = cells.join(there, on, "left_anti").drop("_cell")
    timed = with_next(segments_to.where("start_time IS NOT NULL").select(*keys, "id", "idx", "start_time"), [], keys)
    placed = as_of(once, timed, keys, "start_time", "start_time", ["id", "next_id"], ["idx", "id"])
    placed = placed.withColumns({"status": F.when(F.col("found").isNull(), "unanchored").otherwise("transfer"), "after_id": F.col("found.id"), "before_id": F.col("found.next_id")}).drop("found")
    return placed.select(*donors.columns, "status", "after_id", "before_id").unionByName(twice.select(*donors.columns, "status", "after_id", "before_id"))


def mishomed_words(words: DataFrame, segments: DataFrame, min_overlap: float = 0.05, keys: list[str] = KEYS) -> DataFrame:
    """Words (keys, s, e, text) with a duration that overlap no timed segment by `min_overlap` seconds."""
    chunks = segments.where("start_time IS NOT NULL AND end_time IS NOT NULL").select(*keys, "start_time", "end_time")
    numbered = words.where("e > s").groupBy(*keys, "s", "e", "text").agg(F.count("*").alias("copies"))
    met = overlap_join(numbered, chunks, keys, ("s", "e"), ("start_time", "end_time"))
    most = met.groupBy(*keys, "s", "e", "text").agg(F.max(F.least("e", "end_time") - F.greatest("s", "start_time")).alias("_most"))
    home = most.where(F.col("_most") >= min_overlap)
    return numbered.join(home, [*keys, "s", "e", "text"], "left_anti")


def scan_mishomed(words: DataFrame, segments: DataFrame, proposals: DataFrame | None = None, min_overlap: float = 0.05, keys: list[str] = KEYS) -> DataFrame:
    """Instances of mis-homed words in a row between the same two chunks: keys, instance, prev_idx, next_idx (-1: none), words, text, start_s, end_s, mechanism.

    The chunk before a word is the one that ends last at or before its start, the one behind starts first at or after its end, both with a slack of SLACK
    seconds. With proposals, an instance whose gap has UNCOVERED seconds in a row that no proposal covers is a 'vad-gap', another a 'carve-sliver'.
    """
    chunks = segments.where("start_time IS NOT NULL AND end_time IS NOT NULL").select(*keys, "idx", "start_time", "end_time")
    flagged = cut(mishomed_words(words, segments, min_overlap, keys)).withColumns({"_from": F.col("s") + SLACK, "_until": -(F.col("e") - SLACK)})
    before = chunks.select(*keys, "idx", F.col("end_time").alias("at"), (-F.col("start_time")).alias("late"), (-F.col("idx")).alias("low"))
    rows = as_of(flagged, before, keys, "_from", "at", ["idx", "at"], ["late", "low"]).withColumnRenamed("found", "_p")
    behind = chunks.select(*keys, "idx", F.col("start_time").alias("at"), (-F.col("start_time")).alias("back"), (-F.col("idx")).alias("low"))
    rows = as_of(rows, behind, keys, "_until", "back", ["idx", "at"], ["low"]).withColumnRenamed("found", "_n")
    rows = rows.select(*keys, "s", "e", "text", "copies", F.coalesce("_p.idx", F.lit(-1)).alias("prev_idx"), F.coalesce("_n.idx", F.lit(-1)).alias("next_idx"), F.coalesce("_p.at", F.lit(0.0)).alias("gap_start"), F.col("_n.at").alias("gap_end"))
    rows = cut(rows)
    order = ["s", "e", "text"]
    here = F.struct("prev_idx", "next_idx")
    rows = scan(rows, keys, order, {"_last": ("last", here)}, bucket_of("s"))
    opens = F.col("_last").isNull() | (F.col("_last") != here)
    rows = scan(cut(rows.withColumn("_opens", opens.cast("int"))), keys, order, {"_sum": ("sum", F.col("_opens"))}, bucket_of("s"))
    rows = rows.withColumn("instance", (F.coalesce("_sum", F.lit(0)) + F.col("_opens")).cast("long"))
    said = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("s", "e", "text", "copies"))), lambda w: F.array_repeat(w["text"], w["copies"].cast("int"))))
    found = rows.groupBy(*keys, "instance", "prev_idx", "next_idx").agg(F.sum("copies").alias("words"), F.array_join(said, " ").alias("text"), F.min("s").alias("start_s"), F.max_by("e", F.struct("s", "e")).alias("end_s"), F.first("gap_start").alias("gap_start"), F.first("gap_end").alias("gap_end"))
    if proposals is None:
        return found.withColumn("mechanism", F.lit("unclassified")).drop("gap_start", "gap_end")
    # the gap moved to zero is a bound, and proposals in it are spans: what they leave uncovered are gaps again
    inner = found.where("gap_end > gap_start").select(*keys, "instance", "gap_start", "gap_end")
    spans = proposals.where("end_time > start_time").select(*keys, F.col("start_time").alias("_a"), F.col("end_time").alias("_b"))
    met = overlap_join(inner, spans, keys, ("gap_start", "gap_end"), ("_a", "_b")).select(*keys, "instance", (F.col("_a") - F.col("gap_start")).alias("start_time"), (F.col("_b") - F.col("gap_start")).alias("end_time"))
    bare = gaps(met, inner.select(*keys, "instance", (F.col("gap_end") - F.col("gap_start")).alias("watermark")), [*keys, "instance"])
    longest = bare.groupBy(*keys, "instance").agg(F.max(F.col("end_time") - F.col("start_time")).alias("_bare"))
    open_ended = F.col("gap_end").isNull() | (F.coalesce("_bare", F.lit(0.0)) >= UNCOVERED)
    return found.join(longest, [*keys, "instance"], "left").withColumn("mechanism", F.when(open_ended, "vad-gap").otherwise("carve-sliver")).drop("gap_start", "gap_end", "_bare")
