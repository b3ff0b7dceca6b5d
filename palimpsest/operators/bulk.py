"""Decisions by the million as rows of the overlay: what `writers` does for one gesture, as expressions over a table of decisions.

A decision has id (of its correction), source_id, session_id, created_at and seq, and the fields of its verb; actor, status, rationale,
canonical_form and supersedes_id may be missing. Rows are built on the executors and nothing comes to the driver, so a plan of any size can be
appended with `OverlayStore.append`. What `writers` would refuse with an error is in `refused`, and no row is made of it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.schemas import DIRECTIONS, EDGES, EXTRACTION_STATUSES, GENUINE, PAYLOAD_FIELDS, SESSION_STATUSES, SPEAKER_VERDICTS, SPLIT, SPLIT_PREFIX

GIVEN = {"actor": "human", "status": "applied", "rationale": None, "canonical_form": None, "supersedes_id": None}
WHITE = " \t\n\x0b\x0c\r"


@dataclass
class Written:
    """Rows to append, by table, and the decisions that are refused."""

    corrections: DataFrame
    edges: DataFrame
    refused: DataFrame


def _stripped(col: Column) -> Column:
    return F.btrim(F.coalesce(col, F.lit("")), F.lit(WHITE))


def _ids(*cols: Column) -> Column:
    return F.filter(F.array(*cols), lambda x: x.isNotNull() & (x != ""))


def _named(name: str) -> Column:
    return F.regexp_like(_stripped(F.col(name)), F.lit(r"^[\p{L}\p{N}]"))


def _shaped(decisions: DataFrame) -> DataFrame:
    missing = {n: F.lit(v).cast("string") for n, v in GIVEN.items() if n not in decisions.columns}
    return decisions.withColumns(missing) if missing else decisions


def edge_id(source: Column, target: Column, relation: Column) -> Column:
    """Made from what an edge connects, so that one which comes twice is one."""
    return F.sha2(F.concat_ws("|", source, target, relation), 256).substr(1, 32)


def edges_of(rows: DataFrame, links: dict[str, Column], marked: Column | None = None) -> DataFrame:
    """An edge from each row's id to each id of the arrays in `links` (by relation), and a review marker of its session for each segment in `marked`."""
    array = lambda kind, ids, decision: F.transform(ids, lambda x: F.struct(F.lit(kind).alias("relation_type"), x.alias("target_id"), F.lit(decision).cast("string").alias("decision")))
    every = [array(kind, ids, None) for kind, ids in links.items()]
    if marked is not None:
        every.append(array("REVIEWED", marked, "corrected"))
    own = rows.select("id", "session_id", "created_at", "seq", F.explode(F.concat(*every)).alias("e"))
    reviewed = F.col("e.relation_type") == "REVIEWED"
    source = F.when(reviewed, F.col("session_id")).otherwise(F.col("id"))
    event = F.sha2(F.concat_ws("|", "session_id", "e.target_id", F.lit("REVIEWED"), "id"), 256).substr(1, 32)  # an event, not a state: one for each decision
    return own.select(F.when(reviewed, event).otherwise(edge_id(F.col("id"), F.col("e.target_id"), F.col("e.relation_type"))).alias("id"), source.alias("source_id"), F.col("e.target_id").alias("target_id"), F.col("e.relation_type").alias("relation_type"), F.col("e.decision").alias("decision"), F.when(reviewed, F.col("created_at")).alias("ts"), "seq").dropDuplicates(["id"])


def written(decisions: DataFrame, correction_type: str, operation: str, payload: dict[str, Column], valid: Column | None = None, links: dict[str, Column] | None = None, marked: Column | None = None, canonical: Column | None = None, rationale: Column | None = None) -> Written:
    """One correction for each decision that is `valid`, with its edges; SUPERSEDES follows from supersedes_id."""
    every = _shaped(decisions)
    good = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    rows = every.where(good)
    made = F.struct(*[payload.get(k, F.lit(None)).cast(t).alias(k) for k, t in PAYLOAD_FIELDS.items()])
    corrections = rows.select("id", "source_id", F.lit(correction_type).alias("correction_type"), F.lit(operation).alias("operation"), "status", "session_id", "actor", (F.col("canonical_form") if canonical is None else canonical).alias("canonical_form"), (F.col("rationale") if rationale is None else rationale).alias("rationale"), F.col("created_at").cast("double").alias("created_at"), F.col("seq").cast("long").alias("seq"), made.alias("payload"))
    links = {"SUPERSEDES": _ids(F.col("supersedes_id"))} | (links or {})
    return Written(corrections, edges_of(rows, links, marked), every.where(~good))


def _union(*parts: Written) -> Written:
    return Written(*(reduce(DataFrame.unionByName, x) for x in ([p.corrections for p in parts], [p.edges for p in parts])), parts[0].refused)


# ---- one function for each verb; the fields of its decisions are named in the docstring


def prunes(d: DataFrame) -> Written:
    """segment_ids."""
    ids = F.col("segment_ids")
    return written(d, "grouping", "prune_empty", {"pruned_segment_ids": ids, "pruned_count": F.size(ids)}, None, {"DERIVED_FROM": ids}, ids)


def prune_amendments(d: DataFrame, prior: DataFrame) -> Written:
    """prior_id, rescued (ids): the prior prune (a correction row) without them, which it supersedes."""
    known = prior.select(F.col("id").alias("prior_id"), F.col("payload.pruned_segment_ids").alias("held"), F.col("source_id"))
    rows = d.join(known, "prior_id").withColumns({"left": F.array_except("held", "rescued"), "supersedes_id": F.col("prior_id")})
    return written(rows, "grouping", "prune_empty", {"pruned_segment_ids": F.col("left"), "pruned_count": F.size("left")}, None, {"DERIVED_FROM": F.col("left")})


def text_corrections(d: DataFrame) -> Written:
    """segment_id, new_text, old_text."""
    on = _ids(F.col("segment_id"))
    return written(d, "text_content", "replace_text", {k: F.col(k) for k in ("segment_id", "new_text", "old_text")}, None, {"CORRECTS": on}, on)


def boundary_shifts(d: DataFrame) -> Written:
    """left_id, right_id, text, direction (push or pull)."""
    on = F.array("left_id", "right_id")
    payload = {"boundary_after": F.col("left_id"), "right_segment_id": F.col("right_id"), "text": F.col("text"), "direction": F.col("direction")}
    return written(d, "grouping", "shift_boundary", payload, F.col("direction").isin(*DIRECTIONS), {"CORRECTS": on}, on)


def rejects(d: DataFrame) -> Written:
    """rejected_id, rejected_group (ids or null): proposals, marks, inserts, splits and overlays are all taken back this way."""
    group = F.when(F.size(F.coalesce("rejected_group", F.array().cast("array<string>"))) > 0, F.col("rejected_group"))
    gone = F.concat(_ids(F.col("rejected_id")), F.coalesce(group, F.array().cast("array<string>")))
    return written(d, "review", "reject", {"rejected_id": F.col("rejected_id"), "rejected_group": group}, None, {"SUPERSEDES": gone})


def anchored(anchor: Column) -> Column:
    """The segments an anchor touches; null where it lacks what its kind needs."""
    has = lambda *names: reduce(lambda a, b: a & b, [F.coalesce(anchor[n].cast("string"), F.lit("")) != "" for n in names])
    span = F.when(has("segment_id", "char_start", "char_end", "text_snapshot"), F.array(anchor["segment_id"]))
    boundary = F.when(has("boundary_after", "right_segment_id"), F.array(anchor["boundary_after"], anchor["right_segment_id"]))
    return F.when(anchor["kind"] == "segment", F.when(has("segment_id"), F.array(anchor["segment_id"]))).when(anchor["kind"] == "boundary", boundary).when(anchor["kind"] == "span", span)


def marks(d: DataFrame) -> Written:
    """anchor, mark_class."""
    on = anchored(F.col("anchor"))
    return written(d, "mark", "mark", {"anchor": F.col("anchor"), "mark_class": _stripped(F.col("mark_class"))}, _named("mark_class") & on.isNotNull(), {"CORRECTS": on})


def time_nudges(d: DataFrame) -> Written:
    """edits (one or two of segment_id, edge, old_time, new_time), step_s."""
    edits = F.col("edits")
    good = F.size(edits).between(1, 2) & F.forall(edits, lambda e: e["edge"].isin(*EDGES) & (F.coalesce(e["segment_id"], F.lit("")) != "") & e["new_time"].isNotNull())
    return written(d, "timing", "time_nudge", {"edits": edits, "step_s": F.col("step_s")}, good, {"CORRECTS": F.array_distinct(F.transform(edits, lambda e: e["segment_id"]))})


def chunk_inserts(d: DataFrame) -> Written:
    """after_id, before_id, start_time, end_time, text, label, rank."""
    payload = {"after_segment_id": F.col("after_id"), "before_segment_id": F.col("before_id"), "start_time": F.col("start_time"), "end_time": F.col("end_time"), "text": F.coalesce("text", F.lit("")), "label": F.nullif("label", F.lit("")), "rank": F.nullif(F.col("rank").cast("double"), F.lit(0.0))}
    return written(d, "insertion", "chunk_insert", payload, (F.coalesce("after_id", F.lit("")) != "") & (F.col("end_time") >= F.col("start_time")), {"CORRECTS": _ids(F.col("after_id"), F.col("before_id"))})


def chunk_splits(d: DataFrame) -> Written:
    """segment_id, split_time, end_time, left_text, right_text, old_text, after_id, before_id: three corrections each - the right half as an insert (with the decision's id), the left half's text, and the end moved to the split."""
    good = (_stripped(F.col("left_text")) != "") & (_stripped(F.col("right_text")) != "") & (F.col("split_time") < F.col("end_time")) & (F.coalesce("after_id", F.lit("")) != "")
    tag, part = F.concat(F.lit(SPLIT_PREFIX), F.col("id")), lambda name: F.sha2(F.concat_ws("|", "id", F.lit(name)), 256).substr(1, 32)
    rows = d.withColumn("tag", tag)
    right = {"after_segment_id": F.col("after_id"), "before_segment_id": F.col("before_id"), "start_time": F.col("split_time"), "end_time": F.col("end_time"), "text": F.col("right_text")}
    first = written(rows, "insertion", "chunk_insert", right, good, {"CORRECTS": _ids(F.col("after_id"), F.col("before_id"))}, _ids(F.col("segment_id")), rationale=F.lit(SPLIT))
    text = written(rows.withColumn("id", part("text")), "text_content", "replace_text", {"segment_id": F.col("segment_id"), "new_text": F.col("left_text"), "old_text": F.col("old_text")}, good, {"CORRECTS": _ids(F.col("segment_id"))}, rationale=F.col("tag"))
    moved = F.array(F.struct("segment_id", F.lit("end").alias("edge"), F.col("end_time").cast("double").alias("old_time"), F.col("split_time").cast("double").alias("new_time")))
    times = written(rows.withColumn("id", part("times")), "timing", "time_nudge", {"edits": moved}, good, {"CORRECTS": _ids(F.col("segment_id"))}, rationale=F.col("tag"))
    return _union(first, text, times)


def speaker_assignments(d: DataFrame) -> Written:
    """segment_ids, entity_id, verdict."""
    good = F.col("verdict").isin(*SPEAKER_VERDICTS) & (F.size("segment_ids") > 0) & (F.coalesce("entity_id", F.lit("")) != "")
    return written(d, "speaker", "speaker_assign", {k: F.col(k) for k in ("segment_ids", "entity_id", "verdict")}, good, {"CORRECTS": F.col("segment_ids"), "ASSIGNS": _ids(F.col("entity_id"))}, canonical=F.col("entity_id"))


def speech_overlays(d: DataFrame) -> Written:
    """anchor (of kind span), label, start_time, end_time, text, words, snap."""
    on = anchored(F.col("anchor"))
    good = _named("label") & on.isNotNull() & (F.col("anchor.kind") == "span") & (_stripped(F.col("text")) != "") & (F.col("end_time") > F.col("start_time"))
    payload = {k: F.col(k) for k in ("anchor", "start_time", "end_time", "text", "words")} | {"label": _stripped(F.col("label")), "snap": F.coalesce("snap", F.lit("estimated"))}
    return written(d, "annotation", "speech_overlay", payload, good, {"CORRECTS": on})


# ---- rows of other tables: (rows, edges or None, refused)


def gates(d: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """id, source_id, skeleton_hash, extraction_status, annotated_through, session_id, created_at, seq: gate rows and their GATES edges."""
    good = F.coalesce(F.col("extraction_status").isin(*EXTRACTION_STATUSES), F.lit(False)) & F.coalesce(F.col("annotated_through") >= 0, F.lit(True))
    rows = _shaped(d).where(good)
    out = rows.select("id", "source_id", "skeleton_hash", "extraction_status", F.col("annotated_through").cast("double").alias("annotated_through"), "session_id", "actor", F.col("created_at").cast("double").alias("created_at"), F.col("seq").cast("long").alias("seq"))
    return out, edges_of(rows, {"GATES": _ids(F.col("source_id").cast("string"))}), d.where(~good)


def entities(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, canonical_name, kind, provisional, created_at, seq: entity rows, and the nameless ones."""
    name = _stripped(F.col("canonical_name"))
    rows = _shaped(d).where(name != "")
    out = rows.select("id", name.alias("canonical_name"), F.coalesce("kind", F.lit("person")).alias("kind"), F.coalesce("provisional", F.lit(False)).alias("provisional"), F.array().cast("array<string>").alias("variants"), "actor", F.col("created_at").cast("double").alias("created_at"), F.col("created_at").cast("double").alias("updated_at"), F.col("seq").cast("long").alias("seq"))
    return out, d.where(name == "")


def entity_renames(d: DataFrame, current: DataFrame) -> DataFrame:
    """id, canonical_name, provisional (null: as it was), updated_at, seq: each entity's next row."""
    d = d.select("id", _stripped(F.col("canonical_name")).alias("n"), F.col("provisional").alias("p"), F.col("updated_at").cast("double").alias("u"), F.col("seq").cast("long").alias("s")).where("n <> ''")
    return current.join(d, "id").select("id", F.col("n").alias("canonical_name"), "kind", F.coalesce("p", "provisional").alias("provisional"), "variants", "actor", "created_at", F.col("u").alias("updated_at"), F.col("s").alias("seq"))


def sessions(d: DataFrame) -> DataFrame:
    """id, scope, purpose, started_at, seq: sessions that begin."""
    return d.select("id", F.lit("in_progress").alias("status"), "purpose", "scope", F.col("started_at").cast("double").alias("started_at"), F.col("started_at").cast("double").alias("updated_at"), F.col("seq").cast("long").alias("seq"))


def session_changes(d: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, status or purpose (null: as it was; a blank purpose is the genuine one), updated_at, seq: each session's next row, and refused decisions."""
    good = F.col("status").isNull() | F.col("status").isin(*SESSION_STATUSES)
    new = F.when(F.col("purpose").isNotNull(), F.when(_stripped(F.col("purpose")) == "", GENUINE).otherwise(_stripped(F.col("purpose"))))
    rows = d.where(good).select("id", F.col("status").alias("to"), new.alias("for"), F.col("updated_at").cast("double").alias("u"), F.col("seq").cast("long").alias("s"))
    out = current.join(rows, "id").select("id", F.coalesce("to", "status").alias("status"), F.coalesce("for", "purpose").alias("purpose"), "scope", "started_at", F.col("u").alias("updated_at"), F.col("s").alias("seq"))
    return out, d.where(~good)


def review_markers(d: DataFrame) -> DataFrame:
    """session_id, segment_id, decision, ts, seq: REVIEWED events. As events, not state: the latest of a segment counts."""
    own = F.sha2(F.concat_ws("|", "session_id", "segment_id", F.lit("REVIEWED"), F.col("seq").cast("string")), 256).substr(1, 32)
    return d.select(own.alias("id"), F.col("session_id").alias("source_id"), F.col("segment_id").alias("target_id"), F.lit("REVIEWED").alias("relation_type"), "decision", F.col("ts").cast("double").alias("ts"), F.col("seq").cast("long").alias("seq"))
