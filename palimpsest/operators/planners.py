"""Planning edits as columns over the effective spine: nudges, inserts, splits, gates, marks, cursor windows, seams and audio chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.lineage import cut
from palimpsest.operators.ordering import as_of, bucket_of, scan
from palimpsest.schemas import EDGES

KEYS = ["source_id"]
# fixed values
WELD = 0.01
NEIGHBOUR = ["id", "start_time", "end_time", "is_inserted", "rank"]


def with_neighbours(effective: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The effective spine with structs `prev` and `next` of the rows beside each, and after_id and before_id: the nearest segments that are no inserts, the row itself included on the left."""
    own = F.struct(*NEIGHBOUR)
    real = F.when(~F.col("is_inserted"), F.col("id"))
    rows = scan(cut(effective), keys, ["pos"], {"next": ("next", own), "prev": ("last", own), "_left": ("last", real), "before_id": ("next", real)}, bucket_of("pos"))
    return rows.withColumn("after_id", F.coalesce(F.when(~F.col("is_inserted"), F.col("id")), "_left")).drop("_left")


def plan_time_nudge(edge: str, delta: float, weld: float = WELD) -> Column:
    """Array of edits (segment_id, edge, old_time, new_time) that move an edge of a row of with_neighbours(), and the neighbour's edge welded to it; null where refused.

    An edge can't cross the other edge of its segment or of a welded neighbour, a start can't be negative, and both times must be there.
    """
    if edge not in EDGES:
        return F.lit(None).cast("array<struct<segment_id: string, edge: string, old_time: double, new_time: double>>")
    edit = lambda id_, side, old: F.struct(id_.alias("segment_id"), F.lit(side).alias("edge"), old.alias("old_time"), (old + delta).alias("new_time"))
    start, end = F.col("start_time"), F.col("end_time")
    if edge == "end":
        near, own, fine = F.col("next"), end, end + delta > start
        facing, side, held = near["start_time"], "start", near["start_time"] + delta < near["end_time"]
    else:
        near, own, fine = F.col("prev"), start, (start + delta < end) & (start + delta >= 0)
        facing, side, held = near["end_time"], "end", near["end_time"] + delta > near["start_time"]
    welded = F.coalesce(near["start_time"].isNotNull() & near["end_time"].isNotNull() & (F.abs(facing - own) < weld), F.lit(False))
    both = F.when(welded, F.when(held, F.array(edit(F.col("id"), edge, own), edit(near["id"], side, facing)))).otherwise(F.array(edit(F.col("id"), edge, own)))
    return F.when(start.isNotNull() & end.isNotNull() & fine, both)


def plan_chunk_insert(weld: float = WELD) -> Column:
    """Struct (after_id, before_id, start_s, end_s, welded, rank) for an insert behind a row of with_neighbours(); null where refused.

    It fills the gap to the next row; a gap below `weld`, or none at the end of the spine, gives an insert without duration. An overlap of `weld` or more,
    missing times and a place before the first segment are refused. The rank puts it between inserts with the same start.
    """
    end, right = F.col("end_time"), F.col("next")
    lo = F.when(F.col("is_inserted") & (F.abs(F.col("start_time") - end) < weld), F.coalesce("rank", F.lit(0.0)))
    hi = F.when(right["is_inserted"] & (F.abs(right["start_time"] - end) < weld), F.coalesce(right["rank"], F.lit(0.0)))
    rank = F.when(lo.isNull() & hi.isNull(), 0.0).when(lo.isNull(), hi - 1).when(hi.isNull(), lo + 1).otherwise((lo + hi) / 2)
    gap = right["start_time"] - end
    tail = right.isNull()
    tight = tail | (gap < weld)
    plan = F.struct(F.col("after_id").alias("after_id"), F.when(~tail, F.col("before_id")).alias("before_id"), end.alias("start_s"), F.when(tight, end).otherwise(right["start_time"]).alias("end_s"), tight.alias("welded"), rank.cast("double").alias("rank"))
    timed = F.col("start_time").isNotNull() & end.isNotNull() & F.col("after_id").isNotNull()
    fits = tail | (right["start_time"].isNotNull() & right["end_time"].isNotNull() & (gap >= -weld))
    return F.when(timed & fits, plan)


def plan_chunk_split(caret: Column, text: Column | None = None) -> Column:
    """Struct (segment_id, after_id, before_id, split_s, left_text, right_text, end_s, left_word, right_word) for a split of a row of with_neighbours() at a place of its text; null where refused.

    The time follows the share of characters before the caret, inside the span by 0.01 s or a quarter of it.
    """
    body = F.coalesce(F.col("text") if text is None else text, F.lit(""))
    start, end = F.col("start_time"), F.col("end_time")
    at = F.greatest(F.lit(0), F.least(F.length(body), caret))
    left, right = T.rstrip(F.substring(body, F.lit(1), at)), T.lstrip(F.substring(body, at + 1, F.length(body)))
    eps = F.least(F.lit(0.01), (end - start) / 4)
    split = F.greatest(start + eps, F.least(end - eps, start + (end - start) * (at / F.length(body))))
    plan = F.struct(F.col("id").alias("segment_id"), F.col("after_id"), F.col("before_id"), split.alias("split_s"), left.alias("left_text"), right.alias("right_text"), end.alias("end_s"), T.last_word(left).alias("left_word"), T.first_word(right).alias("right_word"))
    return F.when((left != "") & (right != "") & (end > start) & F.col("after_id").isNotNull(), plan)


def plan_gate(raw: Column, cursor_end: Column, source_end: Column, watermark: Column) -> Column:
    """Struct (extraction_status, annotated_through) of `w`, `w SECONDS`, `signoff`, `exclude` or `resume`; null where refused."""
    words = F.split(T.strip(F.coalesce(raw, F.lit(""))), f"[{T.WS}]+")
    verb, given = F.lower(F.get(words, F.lit(0))), F.get(words, F.lit(1))
    plan = lambda status, at: F.struct(F.lit(status).alias("extraction_status"), at.cast("double").alias("annotated_through"))
    number = F.when(given.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), given.try_cast("double"))
    return (
        F.when((verb == "w") & given.isNotNull() & number.isNotNull(), plan("in_progress", number))
        .when((verb == "w") & given.isNull() & cursor_end.isNotNull(), plan("in_progress", cursor_end))
        .when((verb == "signoff") & source_end.isNotNull(), plan("signed_off", source_end))
        .when(verb == "exclude", plan("excluded", watermark))
        .when(verb == "resume", plan("in_progress", watermark))
    )


def parse_mark(raw: Column, segment_text: Column) -> Column:
    """Struct (mark_class, char_start, char_end, snippet, note) of `class ["snippet"] [note]`; a snippet that the text lacks stays in the note; null for nothing."""
    split = lambda x: F.struct(x.alias("line"), F.regexp_extract(x, "^[^ ]*", 0).alias("head"), T.strip(F.regexp_replace(x, "^[^ ]*", "")).alias("rest"))
    quoted = lambda x: F.struct(*[x[n].alias(n) for n in ("line", "head", "rest")], F.when(x["rest"].rlike('(?s)^"[^"]*"'), F.regexp_extract(x["rest"], '(?s)^"([^"]*)"', 1)).alias("snippet"))
    placed = lambda x: F.struct(*[x[n].alias(n) for n in ("line", "head", "rest", "snippet")], F.nullif(F.call_function("locate", F.nullif(x["snippet"], F.lit("")), F.coalesce(segment_text, F.lit(""))), F.lit(0)).alias("at"))

    def told(x: Column) -> Column:
        note = F.when(x["at"].isNotNull(), T.strip(F.substring(x["rest"], F.length(x["snippet"]) + 3, F.length(x["rest"])))).otherwise(x["rest"])
        found = F.when(x["at"].isNotNull(), x["snippet"])
        return F.when(x["line"] != "", F.struct(x["head"].alias("mark_class"), (x["at"] - 1).alias("char_start"), (x["at"] - 1 + F.length(found)).alias("char_end"), found.alias("snippet"), F.nullif(note, F.lit("")).alias("note")))

    return bind(T.strip(F.coalesce(raw, F.lit(""))), split, quoted, placed, told)


def bind(value: Column, *steps: Callable[[Column], Column]) -> Column:
    """Each step of the one before, computed once however often a step refers to it."""
    out = F.array(value)
    for step in steps:
        out = F.transform(out, step)
    return F.get(out, F.lit(0))


def resolve_mark_class(raw: Column, menu: list[str]) -> Column:
    """Struct (raw, error): a leading number becomes the class of the menu (from 1), the rest stays verbatim; a number out of range is an error."""
    line = T.strip(F.coalesce(raw, F.lit("")))
    head = F.regexp_extract(line, "^[^ ]*", 0)
    rest = F.substring(line, F.length(head) + 2, F.length(line))
    number = F.when(head.rlike("^[0-9]+$"), head.try_cast("int"))
    digits = head.rlike("^[0-9]+$")
    chosen = F.get(F.array(*[F.lit(m) for m in menu]), number - 1)
    good = F.coalesce(number.between(1, len(menu)), F.lit(False))
    error = F.concat(F.lit("no class #"), head, F.lit(f" (menu is 1-{len(menu)})"))
    return F.when(digits & good, F.struct(T.strip(F.concat(chosen, F.lit(" "), rest)).alias("raw"), F.lit(None).cast("string").alias("error"))).otherwise(F.struct(raw.alias("raw"), F.when(digits, error).alias("error")))


def parse_entity(raw: Column) -> Column:
    """Struct (canonical_name, provisional): a leading `?` marks a handle that identifies nobody yet; null for nothing."""
    line = T.strip(F.coalesce(raw, F.lit("")))
    marked = F.startswith(line, F.lit("?"))
    name = F.when(marked, T.strip(F.regexp_replace(line, r"^\?+", ""))).otherwise(line)
    return F.when(name != "", F.struct(name.alias("canonical_name"), marked.alias("provisional")))


def cursor_window(effective: DataFrame, cursors: DataFrame, count: int, keys: list[str] = KEYS) -> DataFrame:
    """The rows around each cursor (keys, cursor), `count` of them where the spine has as many."""
    sizes = effective.groupBy(*keys).agg(F.count("*").alias("_n"))
    start = F.greatest(F.lit(0), F.least(F.greatest(F.lit(0), F.col("cursor") - count // 2), F.col("_n") - count))
    spots = cursors.join(sizes, keys).select(*keys, start.alias("_from"))
    return effective.join(spots, keys).where((F.col("pos") >= F.col("_from")) & (F.col("pos") < F.col("_from") + count)).drop("_from")


def seams(effective: DataFrame, context: float = 2.0, keys: list[str] = KEYS) -> DataFrame:
    """keys, left_pos, left_id, right_id, start_s, end_s, gap_s over each boundary between timed rows: `context` seconds of both sides and what lies between; a negative gap is an overlap."""
    rows = scan(cut(effective), keys, ["pos"], {"_r": ("next", F.struct("id", "start_time", "end_time"))}, bucket_of("pos"))
    r = F.col("_r")
    rows = rows.where("start_time IS NOT NULL AND end_time IS NOT NULL").where(r["start_time"].isNotNull() & r["end_time"].isNotNull())
    return rows.select(*keys, F.col("pos").alias("left_pos"), F.col("id").alias("left_id"), r["id"].alias("right_id"), F.greatest("start_time", F.col("end_time") - context).alias("start_s"), F.least(r["end_time"], r["start_time"] + context).alias("end_s"), (r["start_time"] - F.col("end_time")).alias("gap_s"))


def audio_chunks(effective: DataFrame, audio: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """keys, id, audio_idx, wav_path, start_s, end_s: the audio segment of each row and the row's times within it.

    audio_idx is the place of the last audio segment (keys, start, optional wav_path) that starts at or before the row's start, the first one for earlier
    rows; an insert has that of the segment it follows. Without a path or both times, wav_path and the times are null.
    """
    wav = F.col("wav_path") if "wav_path" in audio.columns else F.lit(None).cast("string")
    coarse = scan(audio.withColumn("wav_path", wav).select(*keys, "id", "start", "wav_path"), keys, ["start", "id"], {"_n": ("count", F.lit(1))}, bucket_of("start"))
    effective = cut(effective)
    coarse = coarse.select(*keys, (F.col("_n") - 1).cast("int").alias("audio_idx"), "start", "wav_path")
    first = coarse.where("audio_idx = 0").select(*keys, F.struct("audio_idx", "start", "wav_path").alias("_first"))
    untimed = effective.where("start_time IS NULL").withColumn("found", F.lit(None).cast(coarse.select(F.struct("audio_idx", "start", "wav_path")).schema[0].dataType))
    rows = as_of(effective.where("start_time IS NOT NULL"), coarse, keys, "start_time", "start", ["audio_idx", "start", "wav_path"], ["audio_idx"]).select(*effective.columns, "found").unionByName(untimed)
    rows = rows.join(first, keys).withColumn("found", F.when(F.col("start_time").isNotNull(), F.coalesce("found", "_first")))
    real = F.when(~F.col("is_inserted"), F.struct(F.col("found.audio_idx").alias("i")))
    rows = scan(cut(rows), keys, ["pos"], {"_flank": ("last", real)}, bucket_of("pos"))
    idx = F.when(F.col("is_inserted") & F.col("_flank").isNotNull(), F.col("_flank.i")).otherwise(F.col("found.audio_idx"))
    ready = F.col("found.wav_path").isNotNull() & F.col("end_time").isNotNull()
    return rows.select(*keys, "id", idx.alias("audio_idx"), F.when(ready, F.col("found.wav_path")).alias("wav_path"), F.when(ready, F.col("start_time") - F.col("found.start")).alias("start_s"), F.when(ready, F.col("end_time") - F.col("found.start")).alias("end_s"))


def gate_line(status: str = "extraction_status", watermark: str = "annotated_through") -> Column:
    return F.when(F.col(status).isNull(), "in_progress · no gate").otherwise(F.concat(F.col(status), F.lit(" · annotated_through "), F.when(F.col(watermark).isNull(), "none").otherwise(F.format_string("%.1fs", F.bround(watermark, 1)))))


def worklist_line() -> Column:
    """A block of text for a row of the review sheet: idx, flags, text and, where they are given, variant and prior texts."""
    return F.concat_ws("\n", F.concat(F.lit("#"), F.col("idx"), F.lit(" ["), F.array_join("flags", ", "), F.lit("]")), F.concat(F.lit("  text:    "), F.coalesce("text", F.lit(""))), F.concat(F.lit("  variant: "), F.col("variant_text")), F.concat(F.lit("  prior:   "), F.col("prior_text")))
