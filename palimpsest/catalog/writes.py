"""Registered queries of the writers: tables of decisions become rows of the overlay, beside the same rows in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.catalog.queries import query
from palimpsest.catalog.views import Views
from palimpsest.operators import bulk
from palimpsest.schemas import schema

def _flat(w: bulk.Written, info: Column, x: Column, y: Column) -> DataFrame:
    """Corrections and edges in common columns."""
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    rows = w.corrections.select(F.lit("correction").alias("kind"), "id", F.col("source_id").cast("string").alias("a"), text.alias("b"), "operation", info.cast("string").alias("info"), x.cast("double").alias("x"), y.cast("double").alias("y"), "actor")
    edges = w.edges.select(F.lit("edge"), "id", "source_id", "target_id", "relation_type", "decision", "ts", none, text)
    return rows.union(edges).withColumnRenamed("operation", "name")


def _sql(of: str, operation: str, valid: str = "true", info: str = "NULL", x: str = "NULL", y: str = "NULL", links: dict[str, str] | None = None, marked: str | None = None, supersedes: bool = False, actor: str = "'human'", more: str = "") -> str:
    """The same rows; `links` and `marked` are lists of ids, `more` further rows of the decisions g."""
    links = (links or {}) | ({"SUPERSEDES": "[supersedes_id]"} if supersedes else {})
    parts = [f"SELECT 'correction' AS kind, id, CAST(source_id AS VARCHAR) AS a, NULL AS b, '{operation}' AS name, {info} AS info, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y, {actor} AS actor FROM g"]
    for relation, ids in links.items():
        parts.append(f"SELECT 'edge', left(sha256(concat_ws('|', id, t, '{relation}')), 32), id, t, '{relation}', NULL, NULL, NULL, NULL FROM (SELECT DISTINCT id, t FROM (SELECT id, unnest({ids}) AS t FROM g) WHERE t <> '')")
    if marked:
        parts.append(f"SELECT 'edge', left(sha256(concat_ws('|', session_id, t, 'REVIEWED', id)), 32), session_id, t, 'REVIEWED', 'corrected', CAST(created_at AS DOUBLE), NULL, NULL FROM (SELECT DISTINCT id, session_id, created_at, t FROM (SELECT id, session_id, created_at, unnest({marked}) AS t FROM g) WHERE t IS NOT NULL)")
    return f"SELECT * FROM (WITH g AS (SELECT * FROM {of} WHERE {valid}) {' UNION ALL '.join(parts)}{more})"


def _decided(v: Views, name: str) -> DataFrame:
    return v.sql(f"SELECT * FROM {name}")


@query("wrt_03_prunes", _sql("fix_d_prune", "prune_empty", info="NULL", x="len(segment_ids)", links={"DERIVED_FROM": "segment_ids"}, marked="segment_ids"))
def _(v: Views) -> DataFrame:
    return _flat(bulk.prunes(_decided(v, "fix_d_prune")), F.lit(None), F.col("payload.pruned_count"), F.lit(None))


@query("wrt_04_prune_amendments", _sql("(SELECT concat('q', source_id) AS id, concat('x', source_id) AS supersedes_id, * EXCLUDE (id) FROM fix_d_prune JOIN (SELECT id AS prior, source_id AS s, list(segment_id) AS held FROM fix_pruned GROUP BY ALL) ON s = source_id)", "prune_empty", x="len(list_filter(held, lambda h: h = 'elsewhere'))", links={"DERIVED_FROM": "list_filter(held, lambda h: h = 'elsewhere')"}, supersedes=True))
def _(v: Views) -> DataFrame:
    d = _decided(v, "fix_d_prune").select(F.concat(F.lit("q"), F.col("source_id")).alias("id"), F.concat(F.lit("x"), F.col("source_id")).alias("prior_id"), "session_id", "created_at", "seq", F.col("segment_ids").alias("rescued"))
    return _flat(bulk.prune_amendments(d, v.prunes), F.lit(None), F.col("payload.pruned_count"), F.lit(None))


@query("wrt_06_text_corrections", _sql("fix_d_text", "replace_text", info="concat(segment_id, '|', new_text, '|', old_text)", links={"CORRECTS": "[segment_id]"}, marked="[segment_id]", supersedes=True, actor="actor"))
def _(v: Views) -> DataFrame:
    p = F.col("payload")
    return _flat(bulk.text_corrections(_decided(v, "fix_d_text")), F.concat_ws("|", p["segment_id"], p["new_text"], p["old_text"]), F.lit(None), F.lit(None))


@query("wrt_08_boundary_shifts", _sql("fix_d_shift", "shift_boundary", "direction IN ('push', 'pull')", "concat_ws('|', left_id, right_id, text, direction)", links={"CORRECTS": "[left_id, right_id]"}, marked="[left_id, right_id]"))
def _(v: Views) -> DataFrame:
    p = F.col("payload")
    return _flat(bulk.boundary_shifts(_decided(v, "fix_d_shift")), F.concat_ws("|", p["boundary_after"], p["right_segment_id"], p["text"], p["direction"]), F.lit(None), F.lit(None))


#: Marks, inserts, splits, overlays and proposals are taken back by one and the same row.
@query("wrt_10_rejects", _sql("fix_d_reject", "reject", info="concat_ws('|', rejected_id, member)", links={"SUPERSEDES": "[rejected_id, member]"}))
def _(v: Views) -> DataFrame:
    d = _decided(v, "fix_d_reject").withColumn("rejected_group", F.array_compact(F.array("member")))
    p = F.col("payload")
    return _flat(bulk.rejects(d), F.concat_ws("|", p["rejected_id"], p["rejected_group"]), F.lit(None), F.lit(None))


def _anchor(kind: Column, right: Column, snapshot: Column) -> Column:
    after = F.when(kind == "boundary", F.col("segment_id"))
    on = F.when(kind != "boundary", F.col("segment_id"))
    return F.struct(kind.alias("kind"), on.alias("segment_id"), after.alias("boundary_after"), right.alias("right_segment_id"), F.col("char_start").cast("int").alias("char_start"), F.col("char_end").cast("int").alias("char_end"), snapshot.alias("text_snapshot"))


@query("wrt_12_marks", _sql("fix_d_mark", "mark", "mark_class <> ' -odd' AND (kind = 'segment' OR (kind = 'boundary' AND right_id IS NOT NULL) OR (kind = 'span' AND snapshot IS NOT NULL))", "concat_ws('|', kind, trim(mark_class))", "char_start", links={"CORRECTS": "CASE WHEN kind = 'boundary' THEN [segment_id, right_id] ELSE [segment_id] END"}))
def _(v: Views) -> DataFrame:
    d = _decided(v, "fix_d_mark")
    d = d.withColumn("anchor", _anchor(F.col("kind"), F.col("right_id"), F.col("snapshot")))
    p = F.col("payload")
    return _flat(bulk.marks(d), F.concat_ws("|", p["anchor"]["kind"], p["mark_class"]), p["anchor"]["char_start"], F.lit(None))


@query("wrt_15_time_nudges", _sql("fix_d_nudge", "time_nudge", "edge <> 'middle'", "concat_ws('|', segment_id, edge, other_id)", "new_time", "CASE WHEN other_id IS NULL THEN 1 ELSE 2 END", links={"CORRECTS": "[segment_id, other_id]"}))
def _(v: Views) -> DataFrame:
    d, none = _decided(v, "fix_d_nudge"), F.lit(None).cast("double")
    one = lambda id_: F.struct(id_.alias("segment_id"), F.col("edge"), none.alias("old_time"), F.col("new_time"))
    d = d.select("*", F.array_compact(F.array(one(F.col("segment_id")), F.when(F.col("other_id").isNotNull(), one(F.col("other_id"))))).alias("edits"), none.alias("step_s"))
    e = F.col("payload.edits")
    return _flat(bulk.time_nudges(d), F.concat_ws("|", e[0]["segment_id"], e[0]["edge"], F.get(e, F.lit(1))["segment_id"]), e[0]["new_time"], F.size(e))


@query("wrt_17_chunk_inserts", _sql("fix_d_insert", "chunk_insert", "end_time >= start_time", "concat_ws('|', after_id, before_id, coalesce(text, ''), label)", "start_time", "nullif(rank, 0)", links={"CORRECTS": "[after_id, before_id]"}))
def _(v: Views) -> DataFrame:
    p = F.col("payload")
    return _flat(bulk.chunk_inserts(_decided(v, "fix_d_insert")), F.concat_ws("|", p["after_segment_id"], p["before_segment_id"], p["text"], p["label"]), p["start_time"], p["rank"])


_HALF = "SELECT 'correction', left(sha256(concat_ws('|', id, '{0}')), 32), CAST(source_id AS VARCHAR), NULL, '{1}', {2}, {3}, NULL, 'human' FROM g UNION ALL SELECT 'edge', left(sha256(concat_ws('|', left(sha256(concat_ws('|', id, '{0}')), 32), segment_id, 'CORRECTS')), 32), left(sha256(concat_ws('|', id, '{0}')), 32), segment_id, 'CORRECTS', NULL, NULL, NULL, NULL FROM g"


@query(
    "wrt_20_chunk_splits",
    _sql("fix_d_split", "chunk_insert", "left_text <> ' ' AND split_time < end_time", "concat('chunk-split|', right_text)", "split_time", "end_time", links={"CORRECTS": "[after_id, before_id]"}, marked="[segment_id]", more=" UNION ALL " + _HALF.format("text", "replace_text", "concat_ws('|', concat('chunk-split:', id), left_text, old_text)", "NULL") + " UNION ALL " + _HALF.format("times", "time_nudge", "concat('chunk-split:', id, '|end')", "split_time")),
)
def _(v: Views) -> DataFrame:
    p = F.col("payload")
    info = F.concat_ws("|", "rationale", F.coalesce(p["text"], p["new_text"]), p["old_text"], p["edits"][0]["edge"])
    return _flat(bulk.chunk_splits(_decided(v, "fix_d_split")), info, F.coalesce(p["start_time"], p["edits"][0]["new_time"]), p["end_time"])


@query("wrt_25_speaker_assignments", _sql("fix_d_assign", "speaker_assign", "verdict <> 'guess' AND entity_id <> ''", "concat_ws('|', entity_id, entity_id, verdict)", "CASE WHEN other_id IS NULL THEN 1 ELSE 2 END", links={"CORRECTS": "[segment_id, other_id]", "ASSIGNS": "[entity_id]"}))
def _(v: Views) -> DataFrame:
    d = _decided(v, "fix_d_assign").withColumn("segment_ids", F.array_compact(F.array("segment_id", "other_id")))
    p = F.col("payload")
    return _flat(bulk.speaker_assignments(d), F.concat_ws("|", "canonical_form", p["entity_id"], p["verdict"]), F.size(p["segment_ids"]), F.lit(None))


@query("wrt_27_speech_overlays", _sql("fix_d_voice", "speech_overlay", "label <> '' AND trim(text) <> '' AND end_time > start_time", "concat_ws('|', segment_id, label, text, 'estimated')", "start_time", "end_time", links={"CORRECTS": "[segment_id]"}))
def _(v: Views) -> DataFrame:
    d = _decided(v, "fix_d_voice")
    d = d.withColumns({"anchor": _anchor(F.lit("span"), F.lit(None).cast("string"), F.col("snapshot")), "words": F.lit(None), "snap": F.lit(None).cast("string")})
    p = F.col("payload")
    return _flat(bulk.speech_overlays(d), F.concat_ws("|", p["anchor"]["segment_id"], p["label"], p["text"], p["snap"]), p["start_time"], p["end_time"])


@query(
    "wrt_30_gates",
    "SELECT * FROM (WITH g AS (SELECT * FROM fix_d_gate WHERE extraction_status <> 'done' AND coalesce(annotated_through, 0) >= 0) SELECT 'gate' AS kind, id, CAST(source_id AS VARCHAR) AS a, NULL AS b, extraction_status AS name, annotated_through AS x FROM g UNION ALL SELECT 'edge', left(sha256(concat_ws('|', id, CAST(source_id AS VARCHAR), 'GATES')), 32), id, CAST(source_id AS VARCHAR), 'GATES', NULL FROM g)",
)
def _(v: Views) -> DataFrame:
    rows, edges, _ = bulk.gates(_decided(v, "fix_d_gate").withColumn("skeleton_hash", F.lit(None).cast("string")))
    rows = rows.select(F.lit("gate").alias("kind"), "id", F.col("source_id").cast("string").alias("a"), F.lit(None).cast("string").alias("b"), F.col("extraction_status").alias("name"), F.col("annotated_through").alias("x"))
    return rows.union(edges.select(F.lit("edge"), "id", "source_id", "target_id", "relation_type", F.lit(None).cast("double")))


_NAMED = "SELECT concat('e', k) AS id, CASE WHEN k % 5 = 0 THEN ' ' ELSE concat(' Name ', k, ' ') END AS canonical_name, k FROM (SELECT DISTINCT k FROM fix_event)"


@query("wrt_23_speaker_entities", f"SELECT id, trim(canonical_name) AS canonical_name, 'person' AS kind, k % 2 = 0 AS provisional, CAST(k AS DOUBLE) AS updated_at FROM ({_NAMED}) WHERE trim(canonical_name) <> ''")
def _(v: Views) -> DataFrame:
    d = v.sql(_NAMED).select("id", "canonical_name", F.lit(None).cast("string").alias("kind"), (F.col("k") % 2 == 0).alias("provisional"), F.col("k").alias("created_at"), F.col("k").alias("seq"))
    return bulk.entities(d)[0].select("id", "canonical_name", "kind", "provisional", "updated_at")


@query("wrt_24_entity_renames", f"SELECT id, concat('New ', k) AS canonical_name, CASE WHEN k % 3 = 0 THEN true ELSE k % 2 = 0 END AS provisional, CAST(k AS DOUBLE) AS created_at, k + 0.5e0 AS updated_at FROM ({_NAMED}) WHERE trim(canonical_name) <> ''")
def _(v: Views) -> DataFrame:
    d = v.sql(_NAMED)
    known = bulk.entities(d.select("id", "canonical_name", F.lit("person").alias("kind"), (F.col("k") % 2 == 0).alias("provisional"), F.col("k").alias("created_at"), F.col("k").alias("seq")))[0]
    renamed = d.select("id", F.concat(F.lit("New "), F.col("k")).alias("canonical_name"), F.when(F.col("k") % 3 == 0, True).alias("provisional"), (F.col("k") + 0.5).alias("updated_at"), F.col("k").alias("seq"))
    return bulk.entity_renames(renamed, known).select("id", "canonical_name", "provisional", "created_at", F.col("updated_at").cast("double").alias("updated_at"))


def _sessions(v: Views) -> DataFrame:
    d = v.view("fix_session").select(F.col("session_id").alias("id"), F.array(F.col("session_id")).alias("scope"), "purpose", F.lit(1.0).alias("started_at"), F.lit(1).alias("seq"))
    return bulk.sessions(d)


@query("wrt_32_session_starts", "SELECT session_id AS id, 'in_progress' AS status, purpose, session_id AS scope, 1e0 AS updated_at FROM fix_session")
def _(v: Views) -> DataFrame:
    return _sessions(v).select("id", "status", "purpose", F.array_join("scope", ",").alias("scope"), "updated_at")


@query(
    "wrt_33_session_changes",
    "SELECT session_id AS id, CASE n WHEN 1 THEN 'completed' WHEN 2 THEN 'reopened' ELSE 'in_progress' END AS status, CASE WHEN n = 3 THEN 'drill' WHEN n = 4 THEN 'genuine' ELSE purpose END AS purpose, 2e0 AS updated_at FROM (SELECT *, CAST(substring(session_id, 2) AS INT) % 5 AS n FROM fix_session) WHERE n > 0",
)
def _(v: Views) -> DataFrame:
    n = F.substring("id", 2, 9).cast("int") % 5
    status = F.when(n == 0, "lost").when(n == 1, "completed").when(n == 2, "reopened")
    d = _sessions(v).select("id", status.alias("status"), F.when(n == 3, " drill ").when(n == 4, " ").alias("purpose"), F.lit(2.0).alias("updated_at"), F.lit(2).alias("seq"))
    return bulk.session_changes(d, _sessions(v))[0].select("id", "status", "purpose", "updated_at")


@query("wrt_35_review_markers", "SELECT left(sha256(concat_ws('|', session_id, segment_id, 'REVIEWED', CAST(seq AS VARCHAR))), 32) AS id, session_id AS source_id, segment_id AS target_id, 'REVIEWED' AS relation_type, decision, ts FROM fix_review")
def _(v: Views) -> DataFrame:
    return bulk.review_markers(v.view("fix_review")).drop("seq")


@query("wrt_36_new_rows", "SELECT DISTINCT left(sha256(concat_ws('|', concat('t', seq), segment_id, 'CORRECTS')), 32) AS id FROM fix_correction WHERE correction_type = 'text_content' AND seq % 2 = 0")
def _(v: Views) -> DataFrame:
    """An append leaves out what is there: half of the edges are, and what is new comes twice."""
    from palimpsest.sources.store import fresh_rows

    edges = bulk.text_corrections(_decided(v, "fix_d_text")).edges.where("relation_type = 'CORRECTS'")
    there = edges.where("seq % 2 = 1").select(*schema("edge").fieldNames())
    return fresh_rows(edges.unionByName(edges), there, ["id"]).select("id")
