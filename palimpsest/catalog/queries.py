"""The registered queries. Each is an operator applied to the derived views, beside the same in DuckDB SQL written on its own."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.catalog.views import Views, with_views
from palimpsest.functions import text as T
from palimpsest.functions import words as FW
from palimpsest.lineage import shared_folder
from palimpsest.operators import intervals, overlay, planners, projection, proposals, selectors, signals, spans, stats, transfer, verdicts
from palimpsest.plans import commands
from palimpsest.sources import readers
from palimpsest.streaming import journal

WS = T.WS

#: DuckDB only: the folds that several of the SQL texts below start from.
OWN_VIEWS = {
    "own_live": "SELECT o.* FROM fix_op o ANTI JOIN fix_supersedes s ON s.target_id = o.id",
    "own_text": "SELECT segment_id, new_text FROM own_live WHERE operation = 'replace_text' AND status = 'applied' QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY created_at DESC, seq DESC) = 1",
    "own_said": "SELECT segment_id, new_text FROM own_live WHERE operation = 'replace_text' QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY created_at DESC, seq) = 1",
    "own_nudge": "SELECT segment_id, edge, new_time FROM own_live WHERE operation = 'time_nudge' QUALIFY row_number() OVER (PARTITION BY segment_id, edge ORDER BY created_at DESC, seq DESC) = 1",
    "own_pruned": "SELECT segment_id FROM fix_pruned WHERE id NOT IN (SELECT id FROM fix_pruned WHERE segment_id NOT IN (SELECT id FROM fix_segment))",
    "own_layer": "SELECT s.source_id, s.id, s.idx, coalesce(t.new_text, s.text) AS text, s.start_time, s.end_time FROM fix_segment s LEFT JOIN own_text t ON t.segment_id = s.id WHERE s.id NOT IN (SELECT segment_id FROM own_pruned)",
    "own_insert": """
SELECT o.id, coalesce(a.source_id, b.source_id) AS source_id, coalesce(a.idx, b.idx) AS idx, coalesce(a.id, b.id) AS flank, CASE WHEN a.id IS NULL THEN -1 ELSE 1 END AS side,
  coalesce(t.new_text, o.body) AS text, o.ins_start, o.ins_end, o.label, o.rank, o.created_at, o.seq, o.rationale, o.session_id
FROM own_live o LEFT JOIN own_layer a ON a.id = o.after_id LEFT JOIN own_layer b ON b.id = o.before_id LEFT JOIN own_said t ON t.segment_id = o.id
WHERE o.operation = 'chunk_insert' AND o.status = 'applied' AND coalesce(a.id, b.id) IS NOT NULL""",
    "own_eff": """
SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY run, inserted, CASE WHEN inserted THEN start_time END NULLS LAST, CASE WHEN inserted THEN rank END, CASE WHEN inserted THEN created_at END, n) - 1 AS pos,
  id, idx, text, start_time, end_time, inserted, label, rank FROM (
  SELECT u.source_id, u.id, u.idx, u.text, coalesce(a.new_time, u.start_time) AS start_time, coalesce(b.new_time, u.end_time) AS end_time, inserted, label, rank, created_at,
    sum(CASE WHEN inserted THEN 0 ELSE 1 END) OVER w AS run, row_number() OVER w AS n
  FROM (SELECT source_id, id, idx, text, start_time, end_time, false AS inserted, NULL AS label, 0e0 AS rank, 0e0 AS created_at, 0 AS seq, id AS flank, 0 AS side FROM own_layer
        UNION ALL SELECT source_id, id, idx, text, ins_start, ins_end, true, label, rank, created_at, seq, flank, side FROM own_insert) u
  LEFT JOIN own_nudge a ON a.segment_id = u.id AND a.edge = 'start' LEFT JOIN own_nudge b ON b.segment_id = u.id AND b.edge = 'end'
  WINDOW w AS (PARTITION BY u.source_id ORDER BY u.idx, flank, side, u.start_time, rank, created_at, seq ROWS UNBOUNDED PRECEDING))""",
    "own_touch": """
SELECT i.id AS insert_id, o.id, o.session_id, o.created_at, o.seq FROM fix_op i JOIN fix_op o ON o.id = i.id OR o.segment_id = i.id WHERE i.operation = 'chunk_insert'""",
    "own_span": """
SELECT e.source_id, e.id AS insert_id, e.label, e.start_time, e.end_time, e.text, trim(e.text) <> '' AS speech, i.session_id
FROM own_eff e JOIN own_insert i ON i.id = e.id WHERE e.inserted AND coalesce(i.rationale, '') <> 'chunk-split'""",
    "own_gate": "SELECT source_id, extraction_status, annotated_through FROM fix_gate QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY created_at DESC) = 1",
    "own_eligible": "SELECT source_id, annotated_through AS watermark FROM own_gate WHERE extraction_status <> 'excluded' AND annotated_through IS NOT NULL",
    "own_genuine": "SELECT session_id FROM fix_session WHERE coalesce(purpose, '') = ''",
    "own_voice": "SELECT * FROM fix_overlay o WHERE NOT EXISTS (SELECT 1 FROM fix_dropped d WHERE d.target_id = o.id) AND end_time IS NOT NULL",
    "own_flag": f"""
SELECT source_id, id, idx, text, CASE WHEN blank THEN 'empty-text' END AS f1, CASE WHEN start_time IS NULL OR end_time IS NULL THEN 'missing-timing' END AS f2,
  CASE WHEN NOT blank AND NOT next_blank AND NOT ends AND upper THEN 'boundary-missing-terminal' END AS f3, CASE WHEN NOT blank AND NOT next_blank AND ends AND letter AND NOT upper THEN 'boundary-terminal-then-lowercase' END AS f4
FROM (SELECT *, NOT regexp_matches(text, '[^{WS}]') AS blank, NOT regexp_matches(following, '[^{WS}]') AS next_blank,
        regexp_matches(text, '[.!?。！？]["'')”’]*[{WS}]*\\z') AS ends, regexp_matches(following, '^["''(“‘]*[{WS}]*\\p{{Lu}}') AS upper, regexp_matches(following, '^[{WS}]*\\p{{L}}') AS letter
      FROM (SELECT *, lead(text) OVER (PARTITION BY source_id ORDER BY idx) AS following FROM fix_segment))""",
    "own_diverge": """
SELECT s.id, s.text, v.transcriber, v.vtext FROM fix_segment s JOIN fix_variant v ON v.segment_id = s.id
WHERE array_to_string(regexp_extract_all(lower(s.text), '[\\p{L}\\p{Nl}\\p{No}]+'), ' ') <> array_to_string(regexp_extract_all(lower(v.vtext), '[\\p{L}\\p{Nl}\\p{No}]+'), ' ')""",
    "own_marker": "SELECT session_id, segment_id, decision FROM (SELECT * FROM fix_review QUALIFY row_number() OVER (PARTITION BY session_id, segment_id ORDER BY ts DESC, seq DESC) = 1) WHERE decision <> 'unreviewed'",
}

_SHIFTED = """
SELECT s.id, CASE WHEN l.direction = 'push' THEN rtrim(substring(rtrim(s.text), 1, length(rtrim(s.text)) - length(l.moved))) WHEN l.direction = 'pull' THEN CASE WHEN rtrim(s.text) = '' THEN l.moved ELSE concat(rtrim(s.text), ' ', l.moved) END
  WHEN r.direction = 'push' THEN CASE WHEN ltrim(s.text) = '' THEN r.moved ELSE concat(r.moved, ' ', ltrim(s.text)) END WHEN r.direction = 'pull' THEN ltrim(substring(ltrim(s.text), length(r.moved) + 1)) ELSE s.text END AS text
FROM fix_segment s LEFT JOIN fix_shift l ON l.left_id = s.id LEFT JOIN fix_shift r ON r.right_id = s.id"""
OWN_VIEWS["own_shifted"] = _SHIFTED
#: The effective spine with boundary shifts before all other corrections, and as an editor shows it, with pruned segments in place.
OWN_VIEWS["own_slayer"] = OWN_VIEWS["own_layer"].replace("coalesce(t.new_text, s.text)", "coalesce(t.new_text, h.text)").replace("LEFT JOIN own_text t", "JOIN own_shifted h ON h.id = s.id LEFT JOIN own_text t")
OWN_VIEWS["own_vlayer"] = OWN_VIEWS["own_layer"].split(" WHERE ")[0]
for _kind in "sv":
    OWN_VIEWS[f"own_{_kind}insert"] = OWN_VIEWS["own_insert"].replace("own_layer", f"own_{_kind}layer")
    OWN_VIEWS[f"own_{_kind}eff"] = OWN_VIEWS["own_eff"].replace("own_layer", f"own_{_kind}layer").replace("own_insert", f"own_{_kind}insert")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of Views as a query, and its SQL, where there is one."""

    def add(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = with_views("duckdb", sql, more=OWN_VIEWS)
        return build

    return add


# ---- sources and readers


@query("src_01_list_sources", "SELECT id, coalesce(title, '') AS title FROM fix_source")
def _(v: Views) -> DataFrame:
    return selectors.match_sources(v.view("fix_source"))


@query("src_02_audio_segments", "SELECT source_id, id, idx FROM fix_audio")
def _(v: Views) -> DataFrame:
    return selectors.audio_segments(v.view("fix_audio"))


@query("src_03_spine_page", "SELECT id, idx, text FROM fix_segment WHERE source_id = 3 ORDER BY idx LIMIT 5 OFFSET 2")
def _(v: Views) -> DataFrame:
    return selectors.page(v.segments.where("source_id = 3"), 5, 2).select("id", "idx", "text")


@query("src_04_decode_references", "SELECT id, idx, text, concat('m', source_id) AS source_locator, CAST(1 + CAST(idx % 2 = 0 AS INT) AS INT) AS slices, concat('h', idx) AS content_hash FROM fix_segment")
def _(v: Views) -> DataFrame:
    ref = lambda node, kind, a, b, h: F.struct(F.struct(node.alias("node_id")).alias("locator"), F.struct(F.lit(kind).alias("kind"), a.cast("double").alias("start"), b.cast("double").alias("end")).alias("slice"), h.alias("content_hash"))
    s, none = v.segments, F.lit(None).cast("string")
    media, own, other = F.concat(F.lit("m"), F.col("source_id")), F.concat(F.lit("t"), F.col("source_id")), F.concat(F.lit("u"), F.col("source_id"))
    char = ref(own, "char", F.lit(0), F.length("text"), F.concat(F.lit("h"), F.col("idx")))
    refs = F.array_compact(F.array(F.when(F.col("idx") % 2 == 0, ref(other, "char", F.lit(0), F.lit(1), none)), ref(media, "time", F.col("start_time"), F.col("end_time"), none), char))
    return readers.decode_segments(s.withColumns({"sources": refs, "text_from": own})).select("id", "idx", "text", "source_locator", F.size("text_slices").alias("slices"), "content_hash")


@query("src_05_empty_segments", "SELECT source_id, id, idx FROM fix_segment WHERE text = ''")
def _(v: Views) -> DataFrame:
    return selectors.empty_segments(v.segments).select("source_id", "id", "idx")


@query("src_06_segment_counts", "SELECT source_id, count(*) AS segments FROM fix_segment GROUP BY source_id")
def _(v: Views) -> DataFrame:
    return stats.spine_counts(v.segments)


@query("src_07_sessions", "SELECT session_id AS id, purpose FROM fix_session WHERE session_id = 'u7'")
def _(v: Views) -> DataFrame:
    return v.sessions.where("id = 'u7'")


@query("src_08_session_corrections", "SELECT id, correction_type FROM fix_op WHERE session_id = 'u7'")
def _(v: Views) -> DataFrame:
    return v.corrections.where("session_id = 'u7'").select("id", "correction_type")


@query("src_09_source_corrections", "SELECT o.id, o.source_id, o.status, o.id IN (SELECT target_id FROM fix_supersedes) AS is_superseded FROM fix_op o")
def _(v: Views) -> DataFrame:
    return overlay.flag_superseded(v.corrections, v.superseded).select("id", "source_id", "status", "is_superseded")


def _review_edges(v: Views) -> DataFrame:
    return v.view("fix_review").select(F.lit("REVIEWED").alias("relation_type"), F.col("session_id").alias("source_id"), F.col("segment_id").alias("target_id"), "decision", "ts", "seq")


@query("src_10_review_markers", "SELECT session_id, segment_id, decision FROM own_marker")
def _(v: Views) -> DataFrame:
    return overlay.review_markers(_review_edges(v))


@query(
    "src_11_variant_texts",
    "SELECT id AS segment_id, t.who AS transcriber, CASE t.who WHEN 'a' THEN whole ELSE substring(whole, idx + 1) END AS variant_text FROM fix_segment JOIN (SELECT doc_id, text AS whole FROM documents) d ON d.doc_id = source_id CROSS JOIN (SELECT 'a' AS who UNION ALL SELECT concat('t', '-b')) t WHERE t.who = 'a' OR idx % 2 = 1",
)
def _(v: Views) -> DataFrame:
    docs = v.sql("SELECT doc_id, text FROM documents")
    t = docs.select(F.concat(F.lit("ta"), F.col("doc_id")).alias("id"), "text", F.lit("a").alias("transcriber")).unionByName(docs.select(F.concat(F.lit("tb"), F.col("doc_id")).alias("id"), "text", F.lit("t-b").alias("transcriber")))
    cut = lambda who, a, b: F.struct(F.concat(F.lit(who), F.col("source_id")).alias("transcript"), a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(None).cast("string").alias("content_hash"))
    slices = F.array(cut("ta", F.lit(2), F.lit(3)), F.when(F.col("idx") % 2 == 1, cut("tb", F.col("idx"), F.lit(2**31 - 1))).otherwise(cut("tb", F.lit(None), F.lit(1))), cut("ta", F.lit(0), F.lit(2**31 - 1)), cut("none", F.lit(0), F.lit(1)))
    return readers.variant_texts(v.segments.withColumn("text_slices", slices), t).drop("pos")


@query("src_13_speaker_entities", "SELECT concat('e', k) AS id, concat('Name ', k, CASE WHEN k % 2 = 0 THEN ' new' ELSE '' END) AS canonical_name, concat('name ', k, CASE WHEN k % 2 = 0 THEN ' new' ELSE '' END) AS sort_name FROM (SELECT DISTINCT k FROM fix_event WHERE k % 3 <> 0)")
def _(v: Views) -> DataFrame:
    e = v.sql("SELECT DISTINCT k FROM fix_event").withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
    new = (F.col("n") == 1) & (F.col("k") % 2 == 0)
    rows = e.select(F.concat(F.lit("e"), F.col("k")).alias("id"), F.concat(F.lit("Name "), F.col("k"), F.when(new, " new").otherwise("")).alias("canonical_name"), F.when(F.col("k") % 3 == 0, "band").otherwise("person").alias("kind"), F.lit(1.0).alias("updated_at"), F.col("n").cast("long").alias("seq"))
    return overlay.speaker_entities(rows).select("id", "canonical_name", "sort_name")


@query("src_15_proposal_set", "SELECT proposal_id, label, start_time, end_time, CAST(source_id AS DOUBLE) AS score, tier FROM fix_proposal")
def _(v: Views) -> DataFrame:
    """All proposals as one set among others: an older one, one of another format, one whose manifest is broken, and one with a broken line for another recording."""
    root = f"{shared_folder(v.spark)}/sets-{uuid.uuid4().hex}"
    rows = v.view("fix_proposal").select("proposal_id", "label", "start_time", "end_time", F.col("source_id").cast("double").alias("score"), "tier")
    for name, at, fmt, media in (("new", 2.0, readers.PROPOSAL_FORMAT, "m"), ("old", 1.0, readers.PROPOSAL_FORMAT, "m"), ("other", 3.0, "another-format", "m"), ("torn", 4.0, readers.PROPOSAL_FORMAT, "n")):
        readers.save_manifest(v.spark, f"{root}/proposals/{name}/manifest.json", {"format": fmt, "proposal_set_id": name, "created_at": at, "source": {"source_id": media}, "files": {"proposals": "rows.jsonl"}})
    rows.write.json(f"{root}/proposals/new/rows.jsonl")
    v.spark.createDataFrame([("{broken",)], "value string").write.text(f"{root}/proposals/torn/rows.jsonl")
    if readers.find_proposal_set(v.spark, root, source_id="n") is not None:
        raise ValueError("a broken set was taken")
    return readers.find_proposal_set(v.spark, root, source_id="m")[1].select("proposal_id", "label", "start_time", "end_time", "score", "tier")


@query("src_18_alignment_words", "SELECT d.doc_id AS source_id, 10e0 * (d.doc_id % 3) + (w.i * 8 - 8) / 16e0 AS s, 10e0 * (d.doc_id % 3) + (w.i * 8 - 1) / 16e0 AS e, w.x AS text FROM documents d, LATERAL (SELECT unnest(range(1, len(string_split(text, ' ')) + 1)) AS i, string_split(text, ' ')[i] AS x) w WHERE d.text <> '' AND d.doc_id % 5 <> 0")
def _(v: Views) -> DataFrame:
    docs = v.sql("SELECT doc_id, text FROM documents")
    t = docs.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("r"), F.col("doc_id")).alias("rendition_id"), "text")
    r = docs.select(F.concat(F.lit("r"), F.col("doc_id")).alias("id"), F.concat(F.lit("a"), F.col("doc_id")).alias("audio_segment_id"))
    a = docs.select(F.concat(F.lit("a"), F.col("doc_id")).alias("id"), F.col("doc_id").alias("source_id"), F.when(F.col("doc_id") % 5 != 0, 10.0 * (F.col("doc_id") % 3)).alias("start"))
    items = F.to_json(F.transform(F.split("text", " "), lambda x, i: F.struct((i * 8 / 16.0).alias("start_time"), ((i * 8 + 7) / 16.0).alias("end_time"), x.alias("text"))))
    cache = docs.where("text <> ''").select(F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("text_hash"), items.alias("items"), F.lit(2.0).alias("created_at")).unionByName(docs.select(F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("text_hash"), F.lit("[]").alias("items"), F.lit(1.0).alias("created_at")))
    return readers.alignment_words(t, r, a, cache).drop("transcript_id")


@query(
    "src_20_source_status",
    """SELECT s.id, coalesce(a.n, 0) AS audio_segments, coalesce(c.n, 0) AS active, coalesce(m.n, 0) AS open_marks FROM fix_source s LEFT JOIN (SELECT source_id, count(*) AS n FROM fix_audio GROUP BY 1) a ON a.source_id = s.source_id
LEFT JOIN (SELECT source_id, count(*) AS n FROM own_live GROUP BY 1) c ON c.source_id = s.source_id LEFT JOIN (SELECT source_id, count(*) AS n FROM own_live WHERE correction_type = 'mark' GROUP BY 1) m ON m.source_id = s.source_id""",
)
def _(v: Views) -> DataFrame:
    out = stats.source_status(v.view("fix_source").select(F.col("source_id").alias("id")), v.view("fix_audio"), v.corrections, v.superseded)
    return out.withColumn("id", F.concat(F.lit("d"), F.col("id")))


# ---- selectors


@query("flt_01_match_sources", "SELECT id, coalesce(title, '') AS title FROM fix_source WHERE id = 'EN' OR contains(lower(coalesce(title, '')), 'en')")
def _(v: Views) -> DataFrame:
    return selectors.match_sources(v.view("fix_source"), "EN")


def _renditions(v: Views) -> DataFrame:
    return v.view("fix_rendition").withColumn("chain", F.when(F.col("chain_text") == "", F.array().cast("array<string>")).otherwise(F.split("chain_text", r"\|")))


@query("flt_02_choose_renditions", "SELECT source_id, id AS rendition_id FROM fix_rendition WHERE contains(lower(coalesce(preprocessing, '')), 'vocals')")
def _(v: Views) -> DataFrame:
    return selectors.choose_renditions(_renditions(v), v.segments, "VOCALS")


@query("flt_03_populated_renditions", "SELECT DISTINCT s.source_id, concat('r', s.source_id, '-', s.source_id % 3) AS rendition_id FROM fix_segment s")
def _(v: Views) -> DataFrame:
    return selectors.choose_renditions(_renditions(v), v.segments.withColumn("rendition_id", F.concat_ws("-", F.concat(F.lit("r"), F.col("source_id")), F.col("source_id") % 3)))


@query("flt_04_rendition_labels", "SELECT id, CASE WHEN is_raw THEN 'raw' ELSE preprocessing END AS label FROM fix_rendition")
def _(v: Views) -> DataFrame:
    return _renditions(v).select("id", selectors.rendition_label().alias("label"))


@query("flt_06_choose_spine", "SELECT id, source_id, skeleton_hash FROM fix_spine WHERE skeleton_hash IS NULL")
def _(v: Views) -> DataFrame:
    return selectors.spine(v.spines, skeleton="Legacy").select("id", "source_id", "skeleton_hash")


@query("flt_10_spine_labels", "SELECT DISTINCT source_id, coalesce(skeleton_hash, 'legacy') AS selector, coalesce(left(split_part(skeleton_hash, ':', -1), 8), 'legacy') AS tag, CASE WHEN skeleton_hash IS NULL THEN 'vad-only (pre-split)' ELSE concat('policy-', idx % 3, ' · ', left(split_part(skeleton_hash, ':', -1), 8)) END AS label FROM fix_spine")
def _(v: Views) -> DataFrame:
    named = selectors.observed_spines(v.spines)
    return named.select("source_id", selectors.spine_selector().alias("selector"), selectors.spine_tag().alias("tag"), F.regexp_replace(selectors.spine_label(), "vad-only ·", "policy-0 ·").alias("label"))


@query("flt_11_active_corrections", "SELECT id, source_id, correction_type, status FROM own_live")
def _(v: Views) -> DataFrame:
    return overlay.active(v.corrections, v.superseded).select("id", "source_id", "correction_type", "status")


@query("flt_13_open_marks", "SELECT id, source_id, mark_class, created_at FROM own_live WHERE operation = 'mark'")
def _(v: Views) -> DataFrame:
    return overlay.open_marks(v.corrections, v.superseded).select("id", "source_id", F.col("payload.mark_class").alias("mark_class"), "created_at")


@query("flt_14_speech_overlays", "SELECT id, segment_id, label FROM fix_overlay WHERE id NOT IN (SELECT target_id FROM fix_dropped)")
def _(v: Views) -> DataFrame:
    return overlay.speech_overlays(v.all_corrections, v.dropped).select("id", F.col("payload.anchor.segment_id").alias("segment_id"), F.col("payload.label").alias("label"))


@query("flt_15_split_groups", "SELECT substring(rationale, 13) AS insert_id, id AS member_id FROM fix_op WHERE rationale LIKE 'chunk-split:%'")
def _(v: Views) -> DataFrame:
    return overlay.split_groups(v.corrections)


@query("flt_16_blank_segments", f"SELECT id, idx FROM fix_segment WHERE NOT regexp_matches(text, '[^{WS}]')")
def _(v: Views) -> DataFrame:
    return signals.empty_positions(v.segments).select("id", "idx")


# ---- signals


@query("sig_01_boundary_flags", "SELECT id, coalesce(f3, f4) AS flag FROM own_flag WHERE coalesce(f3, f4) IS NOT NULL")
def _(v: Views) -> DataFrame:
    return signals.with_next(v.segments, ["text"]).select("id", F.explode(signals.boundary_flags()).alias("flag"))


@query("sig_02_sentence_edges", f"""SELECT id, regexp_matches(text, '[.!?。！？]["'')”’]*[{WS}]*\\z') AS ends, regexp_matches(text, '^["''(“‘]*[{WS}]*\\p{{Lu}}') AS starts FROM fix_segment""")
def _(v: Views) -> DataFrame:
    return v.segments.select("id", T.ends_terminal(F.col("text")).alias("ends"), T.starts_upper(F.col("text")).alias("starts"))


@query("sig_04_coverage_flags", "SELECT id, CASE WHEN idx % 7 = 3 OR trim(text) = '' THEN CASE WHEN idx % 4 = 0 THEN 'empty-text,missing-timing' ELSE 'empty-text' END ELSE 'missing-timing' END AS flags FROM fix_segment WHERE idx % 4 = 0 OR idx % 7 = 3 OR trim(text) = ''")
def _(v: Views) -> DataFrame:
    rows = v.segments.withColumn("end_time", F.when(F.col("idx") % 4 != 0, F.col("end_time")))
    return rows.select("id", F.array_join(signals.coverage_flags(), ",").alias("flags")).where("flags <> ''")


def _variants(v: Views) -> DataFrame:
    return v.view("fix_variant").select("segment_id", "transcriber", F.col("vtext").alias("variant_text"))


@query("sig_05_variant_divergence", "SELECT id, text, transcriber, vtext AS variant_text FROM own_diverge")
def _(v: Views) -> DataFrame:
    return signals.divergence(v.segments, _variants(v))


@query("sig_06_normal_words", "SELECT id, array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{Nl}\\p{No}]+'), ' ') AS words FROM fix_segment")
def _(v: Views) -> DataFrame:
    return v.segments.select("id", T.normal_words(F.col("text")).alias("words"))


@query("sig_07_signal_flags", "SELECT f.id, concat_ws(',', f1, f2, f3, f4, CASE WHEN d.id IS NOT NULL THEN 'transcriber-divergence' END) AS flags FROM own_flag f LEFT JOIN own_diverge d ON d.id = f.id")
def _(v: Views) -> DataFrame:
    return signals.signal_flags(v.segments, _variants(v)).select("id", F.array_join("flags", ",").alias("flags"))


@query("sig_08_edit_distance", "SELECT p_partkey, levenshtein(string_split(p_name, ' ')[1], string_split(p_name, ' ')[2]) AS edits FROM part")
def _(v: Views) -> DataFrame:
    w = F.split("p_name", " ")
    return v.sql("SELECT p_partkey, p_name FROM part").select("p_partkey", T.edit_distance(w[0], w[1]).cast("long").alias("edits"))


_CODED = "translate(regexp_replace(lower(w), '[^\\p{L}]', '', 'g'), 'bfpvcgjkqsxzdtlmnr', '111122222222334556')"
_RUNS = f"regexp_replace({_CODED}, '[^1-6]', '0', 'g')"
for _d in "0123456":
    _RUNS = f"regexp_replace({_RUNS}, '{_d}+', '{_d}', 'g')"


@query("sig_09_phonetic_keys", f"SELECT DISTINCT w AS word, CASE WHEN regexp_matches(w, '\\p{{L}}') THEN left(concat(left(regexp_replace(lower(w), '[^\\p{{L}}]', '', 'g'), 1), replace(substring({_RUNS}, 2), '0', ''), '000'), 4) ELSE '' END AS key FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents)")
def _(v: Views) -> DataFrame:
    words = v.sql("SELECT text FROM documents").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return words.select("word", T.phonetic_key(F.col("word")).alias("key"))


#: DuckDB's edit distance counts bytes; each letter of the test tables beyond ASCII gets a sign of one byte that normal words lack.
_ONE_BYTE = "translate(lower({0}), 'àáâäæçèéêëìíîïñòóôöøùúûüÿœßåãõ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ#$%&')"


@query(
    "sig_10_variant_clusters",
    f"""WITH RECURSIVE heard AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos, w) AS n FROM (SELECT w, pos, left(concat(left(regexp_replace(lower(w), '[^\\p{{L}}]', '', 'g'), 1), replace(substring({_RUNS}, 2), '0', ''), '000'), 4) AS key
  FROM (SELECT w, min(doc_id) AS pos FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+')) AS w FROM documents) GROUP BY 1) WHERE regexp_matches(w, '\\p{{L}}'))),
step AS (SELECT key, 0::BIGINT AS n, []::VARCHAR[] AS leaders, ''::VARCHAR AS cluster, ''::VARCHAR AS w FROM (SELECT DISTINCT key FROM heard)
  UNION ALL SELECT h.key, h.n, CASE WHEN hit IS NULL THEN list_append(leaders, h.w) ELSE leaders END, coalesce(hit, h.w), h.w FROM step s JOIN heard h ON h.key = s.key AND h.n = s.n + 1,
  LATERAL (SELECT list_filter(leaders, lambda l: levenshtein({_ONE_BYTE.format("l")}, {_ONE_BYTE.format("h.w")}) <= 2)[1] AS hit) x)
SELECT cluster, row_number() OVER (PARTITION BY key, cluster ORDER BY n) - 1 AS pos, w AS word FROM step WHERE n > 0 QUALIFY count(*) OVER (PARTITION BY key, cluster) > 1""".replace("\\\\p", "\\p"),
)
def _(v: Views) -> DataFrame:
    words = v.sql("SELECT doc_id, text FROM documents").select("doc_id", F.explode(F.array_distinct(T.word_list(F.col("text")))).alias("word"))
    return signals.cluster_variants(words.groupBy("word").agg(F.min("doc_id").alias("pos")))


@query(
    "sig_11_speaker_turns",
    """SELECT source_id, id, speaker, round_even(s, 3) AS overlap, round_even(least(1e0, s / (end_time - start_time)), 3) AS coverage FROM (
SELECT s.source_id, s.id, s.start_time, s.end_time, t.speaker, sum(least(s.end_time, t.turn_end) - greatest(s.start_time, t.turn_start)) AS s, min((t.turn_start, t.turn_end)) AS first
FROM fix_segment s JOIN fix_turn t ON t.source_id = s.source_id AND t.turn_start < s.end_time AND t.turn_end > s.start_time WHERE trim(s.text) <> '' AND s.end_time > s.start_time GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, first, speaker) = 1""",
)
def _(v: Views) -> DataFrame:
    return proposals.speaker_turns(v.segments, v.view("fix_turn"))


@query(
    "sig_12_event_proposals",
    """SELECT p.source_id, p.proposal_id, coalesce((SELECT arg_max(s.id, (s.start_time, s.idx)) FROM fix_segment s WHERE s.source_id = p.source_id AND s.start_time <= p.start_time), (SELECT arg_min(s.id, (s.start_time, s.idx)) FROM fix_segment s WHERE s.source_id = p.source_id)) AS segment_id
FROM fix_proposal p WHERE end_time > start_time AND coalesce((SELECT arg_max(o.end_time, (o.start_time, o.end_time)) FROM own_span o WHERE o.source_id = p.source_id AND o.label <> '' AND o.start_time <= p.end_time), -1) <= p.start_time""",
)
def _(v: Views) -> DataFrame:
    taken = _spans(v).where("label <> ''")
    return proposals.event_proposals(v.segments, v.view("fix_proposal"), taken).select("source_id", "proposal_id", "segment_id")


@query("sig_13_worklist", "SELECT f.id, concat_ws(',', f1, f2, f3, f4) AS flags FROM own_flag f WHERE concat_ws(',', f1, f2, f3, f4) <> '' AND id NOT IN (SELECT segment_id FROM own_marker WHERE session_id = 'u7')")
def _(v: Views) -> DataFrame:
    return signals.worklist(signals.signal_flags(v.segments), overlay.review_markers(_review_edges(v), "u7")).select("id", F.array_join("flags", ",").alias("flags"))


# ---- joins


@query("jon_01_prior_by_hash", "SELECT DISTINCT o.id, concat('h', s.idx % 40) AS content_hash FROM fix_op o JOIN fix_segment s ON s.id = o.segment_id WHERE o.operation <> 'speaker_assign'")
def _(v: Views) -> DataFrame:
    edges = v.view("fix_op").where("segment_id IS NOT NULL AND operation <> 'speaker_assign'").select(F.col("id").alias("source_id"), F.col("segment_id").alias("target_id"), F.lit("CORRECTS").alias("relation_type"))
    held = v.segments.select("id", F.concat(F.lit("h"), F.col("idx") % 40).alias("content_hash"), F.lit(None).cast("array<struct<transcript: string, start: int, end: int, content_hash: string>>").alias("text_slices"))
    return overlay.prior_by_hash(v.corrections, edges, held).select("id", "content_hash")


@query("jon_02_latest_texts", "SELECT segment_id, new_text FROM own_said WHERE segment_id IN (SELECT id FROM fix_segment)")
def _(v: Views) -> DataFrame:
    return overlay.latest_texts(v.corrections, v.superseded, v.segments).select("segment_id", F.col("payload.new_text").alias("new_text"))


_BENCH = """WITH RECURSIVE {views},
pair AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY pass, d, p_start, proposal_id, i_start, i_end, insert_id) AS n FROM (
  SELECT p.source_id, p.proposal_id, i.insert_id, x.pass, abs((i.start_time + i.end_time) / 2 - (p.start_time + p.end_time) / 2) AS d, p.start_time AS p_start, i.start_time AS i_start, i.end_time AS i_end
  FROM fix_proposal p JOIN own_span i ON i.source_id = p.source_id AND i.label <> '' AND i.start_time >= 0 AND abs((i.start_time + i.end_time) / 2 - (p.start_time + p.end_time) / 2) < 2
  JOIN (SELECT unnest([1, 2, 3, 4]) AS pass) x ON (x.pass > 2) = (p.tier = 2) AND (x.pass % 2 = 0 OR i.label = p.label))),
step AS (SELECT source_id, 0::BIGINT AS n, []::VARCHAR[] AS ps, []::VARCHAR[] AS hs FROM (SELECT DISTINCT source_id FROM pair)
  UNION ALL SELECT s.source_id, p.n, CASE WHEN free THEN list_append(ps, p.proposal_id) ELSE ps END, CASE WHEN free THEN list_append(hs, p.insert_id) ELSE hs END
  FROM step s JOIN pair p ON p.source_id = s.source_id AND p.n = s.n + 1, LATERAL (SELECT NOT list_contains(ps, p.proposal_id) AND NOT list_contains(hs, p.insert_id) AS free) f),
done AS (SELECT source_id, unnest(ps) AS proposal_id, unnest(hs) AS insert_id FROM (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY n DESC) = 1)),
verdict AS (SELECT p.source_id, p.proposal_id, p.tier, d.insert_id, CASE WHEN d.insert_id IS NULL THEN CASE WHEN p.tier = 1 THEN 'rejected' ELSE 'unaccepted' END WHEN i.label <> p.label THEN 'relabeled'
  WHEN abs(i.start_time - p.start_time) <= 0.15 AND abs(i.end_time - p.end_time) <= 0.15 THEN 'accepted' ELSE 'edited' END AS verdict
  FROM fix_proposal p LEFT JOIN done d ON d.proposal_id = p.proposal_id LEFT JOIN own_span i ON i.insert_id = d.insert_id)
"""


def _bench_sql(tail: str) -> str:
    made = with_views("duckdb", "SELECT * FROM fix_proposal, own_span", more=OWN_VIEWS)
    return _BENCH.replace("{views}", made.removeprefix("WITH ").rsplit("\nSELECT * FROM fix_proposal, own_span", 1)[0]) + tail


def _spans(v: Views) -> DataFrame:
    return spans.insert_spans(v.placed, v.corrections, v.superseded)


@query("jon_04_verdicts")
def _(v: Views) -> DataFrame:
    return verdicts.Bench(v.view("fix_proposal"), _spans(v)).verdicts.select("source_id", "proposal_id", "tier", "insert_id", "verdict")


@query("jon_04_verdict_counts")
def _(v: Views) -> DataFrame:
    return verdicts.Bench(v.view("fix_proposal"), _spans(v)).counts.groupBy("tier", "verdict").agg(F.sum("n").alias("n"))


@query("jon_04_missed")
def _(v: Views) -> DataFrame:
    return verdicts.Bench(v.view("fix_proposal"), _spans(v)).missed.select("source_id", "insert_id", "label")


ORACLE_SQL |= {
    "jon_04_verdicts": _bench_sql("SELECT source_id, proposal_id, tier, insert_id, verdict FROM verdict"),
    "jon_04_verdict_counts": _bench_sql("SELECT tier, verdict, count(*) AS n FROM verdict GROUP BY ALL"),
    "jon_04_missed": _bench_sql("SELECT source_id, insert_id, label FROM own_span WHERE label <> '' AND start_time >= 0 AND insert_id NOT IN (SELECT insert_id FROM done)"),
}


@query("jon_05_wordless_donors", "SELECT source_id, id AS insert_id, label, start_time, end_time, rank FROM own_eff WHERE inserted AND label <> '' AND trim(text) = ''")
def _(v: Views) -> DataFrame:
    return transfer.wordless_donors(v.placed)


@query("jon_05_word_bearing", "SELECT source_id, count(*) AS n FROM own_eff WHERE inserted AND label <> '' AND trim(text) <> '' GROUP BY source_id")
def _(v: Views) -> DataFrame:
    return transfer.word_bearing(v.effective)


@query("jon_06_foreign_overlays", "SELECT id AS overlay_id FROM own_voice WHERE segment_id NOT IN (SELECT id FROM fix_spine WHERE skeleton_hash IS NULL)")
def _(v: Views) -> DataFrame:
    return spans.foreign_overlays(overlay.overlay_spans(v.overlays, v.dropped), v.spines.where("skeleton_hash IS NULL")).select("overlay_id")


@query("jon_07_observed_spines", "SELECT source_id, skeleton_hash, count(*) AS segments, arg_max(nullif(split_policy, ''), idx) FILTER (split_policy <> '') AS split_policy FROM fix_spine GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return selectors.observed_spines(v.spines)


@query("jon_08_source_spines", "SELECT source_id, skeleton_hash, count(*) AS segments FROM fix_spine WHERE source_id % 3 = 1 GROUP BY ALL")
def _(v: Views) -> DataFrame:
    """The denoised rendition, which one source in three has its segments under."""
    held = v.spines.withColumn("rendition_id", F.concat_ws("-", F.concat(F.lit("r"), F.col("source_id")), F.col("source_id") % 3))
    return selectors.source_spines(held, _renditions(v).withColumn("preprocessing", F.coalesce("preprocessing", F.lit("raw"))), "denoised").select("source_id", "skeleton_hash", "segments")


# ---- folds


@query(
    "agg_01_correction_stats",
    """SELECT source_id, kind, name, count(*) AS n FROM (
SELECT source_id, 'active' AS kind, '' AS name FROM own_live UNION ALL SELECT source_id, 'op', correction_type FROM own_live
UNION ALL SELECT source_id, 'insert_label', coalesce(nullif(label, ''), '(unlabeled)') FROM own_live WHERE operation = 'chunk_insert' AND coalesce(rationale, '') <> 'chunk-split'
UNION ALL SELECT source_id, 'splits', '' FROM own_live WHERE operation = 'chunk_insert' AND rationale = 'chunk-split'
UNION ALL SELECT source_id, 'open_marks', '' FROM own_live WHERE operation = 'mark' UNION ALL SELECT source_id, 'mark_class', mark_class FROM own_live WHERE operation = 'mark') GROUP BY ALL""",
)
def _(v: Views) -> DataFrame:
    return stats.correction_stats(v.corrections, v.superseded)


@query("agg_02_latest_gates", "SELECT source_id, extraction_status, annotated_through FROM own_gate")
def _(v: Views) -> DataFrame:
    return overlay.latest_gates(v.gates).select("source_id", "extraction_status", "annotated_through")


@query("agg_03_session_purposes", "SELECT c.source_id, CASE WHEN coalesce(purpose, '') = '' THEN 'genuine' ELSE purpose END AS purpose, count(*) AS n FROM (SELECT DISTINCT session_id, source_id FROM fix_correction) c JOIN fix_session s ON s.session_id = c.session_id GROUP BY ALL")
def _(v: Views) -> DataFrame:
    scope = v.view("fix_correction").groupBy("session_id").agg(F.collect_set("source_id").alias("scope"))
    return overlay.session_purposes(v.view("fix_session").join(scope, "session_id"))


@query("agg_04_speaker_assignments", "SELECT segment_id, entity_id, id AS correction_id FROM own_live WHERE operation = 'speaker_assign' QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY created_at DESC, seq DESC) = 1")
def _(v: Views) -> DataFrame:
    return overlay.assignments(v.corrections, v.superseded).select("segment_id", "entity_id", "correction_id")


_GAPS = """
SELECT source_id, reached AS start_time, s AS end_time FROM (SELECT *, coalesce(max(e) OVER (PARTITION BY source_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM clipped) WHERE s > reached
UNION ALL SELECT g.source_id, coalesce(m.e, 0), g.watermark FROM own_eligible g LEFT JOIN (SELECT source_id, max(e) AS e FROM clipped GROUP BY 1) m ON m.source_id = g.source_id WHERE g.watermark > coalesce(m.e, 0)"""


@query("agg_05_negative_regions", "SELECT * FROM (WITH clipped AS (SELECT t.source_id, greatest(turn_start, 0) AS s, least(turn_end, watermark) AS e FROM fix_turn t JOIN own_eligible g ON g.source_id = t.source_id WHERE watermark > 0 AND least(turn_end, watermark) > turn_start)" + _GAPS + ")")
def _(v: Views) -> DataFrame:
    turns = v.view("fix_turn").withColumnsRenamed({"turn_start": "start_time", "turn_end": "end_time"})
    return spans.negative_regions(turns, spans.eligible_gates(v.gates))


@query(
    "agg_06_insert_spans",
    """SELECT s.source_id, s.insert_id, s.label, s.start_time, s.end_time, s.text, s.speech, p.ops, p.sessions FROM own_span s
JOIN (SELECT insert_id, string_agg(id, ',' ORDER BY created_at, seq) AS ops, array_to_string(list_sort(list(DISTINCT session_id)), ',') AS sessions FROM own_touch GROUP BY 1) p ON p.insert_id = s.insert_id""",
)
def _(v: Views) -> DataFrame:
    return _spans(v).select("source_id", "insert_id", "label", "start_time", "end_time", "text", "speech", F.array_join("op_ids", ",").alias("ops"), F.array_join("session_ids", ",").alias("sessions"))


@query("agg_07_overlay_spans", "SELECT source_id, id AS overlay_id, segment_id, label, snapshot AS text, start_time, end_time, char_start, char_end, session_id FROM own_voice")
def _(v: Views) -> DataFrame:
    return overlay.overlay_spans(v.overlays, v.dropped).drop("snap", "words", "op_ids")


def _extraction(v: Views) -> spans.Extraction:
    return spans.Extraction(v.segments, v.all_corrections, v.dropped, v.gates, overlay.sessions_for(v.sessions, ["genuine"]))


_EVENTS = """SELECT s.source_id, 'insert' AS kind, s.insert_id AS event_id, s.label, s.start_time, s.end_time, CASE WHEN coalesce(s.label, '') = '' THEN 'unlabeled' WHEN s.start_time >= g.watermark THEN 'above_watermark' WHEN s.session_id NOT IN (SELECT session_id FROM own_genuine) THEN 'session_purpose' END AS reason
FROM own_span s JOIN own_eligible g ON g.source_id = s.source_id
UNION ALL SELECT o.source_id, 'overlay', o.id, o.label, o.start_time, o.end_time, CASE WHEN o.start_time >= g.watermark THEN 'overlay_above_watermark' WHEN o.session_id NOT IN (SELECT session_id FROM own_genuine) THEN 'overlay_session_purpose' END FROM own_voice o JOIN own_eligible g ON g.source_id = o.source_id"""


@query("agg_08_examples", f"SELECT source_id, kind, event_id, label, start_time, end_time FROM ({_EVENTS}) WHERE reason IS NULL")
def _(v: Views) -> DataFrame:
    return _extraction(v).examples.select("source_id", "kind", "event_id", "label", "start_time", "end_time")


@query("agg_08_skipped", f"SELECT reason AS skip_reason, count(*) AS n FROM ({_EVENTS}) WHERE reason IS NOT NULL GROUP BY 1")
def _(v: Views) -> DataFrame:
    return _extraction(v).skipped


_SPEECH = "SELECT e.source_id, e.id, e.start_time, least(e.end_time, g.watermark) AS end_time, e.text FROM own_eff e JOIN own_eligible g ON g.source_id = e.source_id WHERE trim(e.text) <> '' AND e.start_time < g.watermark AND e.end_time > e.start_time"


@query("agg_08_speech", _SPEECH)
def _(v: Views) -> DataFrame:
    return _extraction(v).speech.drop("spine")


@query(
    "agg_08_negatives",
    f"SELECT * FROM (WITH clipped AS (SELECT o.source_id, greatest(start_time, 0) AS s, least(end_time, watermark) AS e FROM (SELECT source_id, start_time, end_time FROM own_span UNION ALL SELECT source_id, start_time, end_time FROM ({_SPEECH})) o JOIN own_eligible g ON g.source_id = o.source_id WHERE watermark > 0 AND least(end_time, watermark) > greatest(start_time, 0))" + _GAPS + ")",
)
def _(v: Views) -> DataFrame:
    return _extraction(v).negatives.drop("spine")


@query("agg_09_vocabulary", f"SELECT label, count(*) AS n FROM ({_EVENTS}) WHERE reason IS NULL GROUP BY 1")
def _(v: Views) -> DataFrame:
    return _extraction(v).vocabulary


@query("agg_09_events", f"SELECT CASE e.kind WHEN 'insert' THEN 'labeled_span' ELSE 'speech_overlay' END AS kind, e.source_id, s.title AS source_title, s.content_hash AS source_content_hash, event_id AS id, label, start_time, end_time, 'train' AS split FROM ({_EVENTS}) e JOIN fix_source s ON s.source_id = e.source_id WHERE reason IS NULL")
def _(v: Views) -> DataFrame:
    sources = v.view("fix_source").select(F.col("source_id").alias("id"), "title", F.lit(None).cast("string").alias("path"), "content_hash")
    return commands.dataset_events(_extraction(v), sources).select("kind", "source_id", "source_title", "source_content_hash", "id", "label", "start_time", "end_time", "split")


@query(
    "agg_09_regions",
    f"SELECT 'speech' AS kind, source_id, start_time, end_time FROM ({_SPEECH}) UNION ALL SELECT 'negative', * FROM (WITH clipped AS (SELECT o.source_id, greatest(start_time, 0) AS s, least(end_time, watermark) AS e FROM (SELECT source_id, start_time, end_time FROM own_span UNION ALL SELECT source_id, start_time, end_time FROM ({_SPEECH})) o JOIN own_eligible g ON g.source_id = o.source_id WHERE watermark > 0 AND least(end_time, watermark) > greatest(start_time, 0))" + _GAPS + ")",
)
def _(v: Views) -> DataFrame:
    return commands.dataset_regions(_extraction(v)).drop("skeleton_hash")


# ---- projection


@query("prj_01_effective_spine", "SELECT source_id, pos, id, idx, text, start_time, end_time, inserted AS is_inserted, label, rank FROM own_eff")
def _(v: Views) -> DataFrame:
    return v.projected()


@query("prj_01_with_shifts", "SELECT source_id, pos, id, idx, text, start_time, end_time, inserted AS is_inserted, label, rank FROM own_seff")
def _(v: Views) -> DataFrame:
    return projection.effective_spine(v.segments, v.corrections.unionByName(v.prunes).unionByName(v.shifts), v.superseded)


@query("prj_02_text_edits", "SELECT id AS correction_id, CASE operation WHEN 'replace_text' THEN 'replace_text' END AS edit, new_text AS text, segment_id AS target FROM own_live WHERE operation = 'replace_text' AND status = 'applied' UNION ALL SELECT id, 'prune', NULL, segment_id FROM fix_pruned")
def _(v: Views) -> DataFrame:
    edits = projection.text_edits(overlay.active(v.corrections.unionByName(v.prunes), v.superseded))
    return edits.select("correction_id", "edit", "text", F.explode("targets").alias("target"))


@query(
    "prj_03_chunk_inserts",
    """SELECT coalesce(a.source_id, b.source_id) AS source_id, o.id, coalesce(a.id, b.id) AS flank_id, CASE WHEN a.id IS NULL THEN -1 ELSE 1 END AS side, coalesce(t.new_text, o.body) AS text, o.ins_start AS start_time, o.rank
FROM own_live o LEFT JOIN fix_segment a ON a.id = o.after_id LEFT JOIN fix_segment b ON b.id = o.before_id LEFT JOIN own_said t ON t.segment_id = o.id WHERE o.operation = 'chunk_insert' AND o.status = 'applied' AND coalesce(a.id, b.id) IS NOT NULL""",
)
def _(v: Views) -> DataFrame:
    return projection.apply_chunk_inserts(v.segments, v.corrections, v.superseded).select("source_id", "id", "flank_id", "side", "text", "start_time", "rank")


@query("prj_04_time_nudges", "SELECT segment_id AS id, max(CASE WHEN edge = 'start' THEN new_time END) AS new_start, max(CASE WHEN edge = 'end' THEN new_time END) AS new_end FROM own_nudge GROUP BY 1")
def _(v: Views) -> DataFrame:
    return projection.nudged_times(overlay.active(v.corrections, v.superseded))


@query("prj_05_insert_runs", "SELECT source_id, pos, id FROM own_eff WHERE inserted")
def _(v: Views) -> DataFrame:
    return v.placed.where("is_inserted").select("source_id", "pos", "id")


@query(
    "prj_06_boundary_shifts",
    "SELECT h.id, CAST(s.idx AS BIGINT) AS pos, h.text FROM own_shifted h JOIN fix_segment s ON s.id = h.id",
)
def _(v: Views) -> DataFrame:
    return projection.effective_spine(v.segments, v.shifts, v.superseded).select("id", "pos", "text")


@query("prj_06_plan_shift", "SELECT id, regexp_extract(text, '([^ ]+) *$', 1) AS moved, rtrim(regexp_replace(text, '[^ ]+ *$', '')) AS \"left\" FROM fix_segment WHERE trim(text) <> ''")
def _(v: Views) -> DataFrame:
    plan = projection.plan_boundary_shift(F.col("text"), F.lit("next words"), "push")
    return v.segments.select("id", plan.alias("p")).where("p IS NOT NULL").select("id", "p.moved", "p.left")


@query("prj_06_plan_pull", "SELECT id, regexp_extract(text, '^ *([^ ]+)', 1) AS moved, concat('words before ', regexp_extract(text, '^ *([^ ]+)', 1)) AS \"left\", ltrim(regexp_replace(text, '^ *[^ ]+', '')) AS \"right\" FROM fix_segment WHERE trim(text) <> ''")
def _(v: Views) -> DataFrame:
    plan = projection.plan_boundary_shift(F.lit("words before"), F.col("text"), "pull")
    return v.segments.select("id", plan.alias("p")).where("p IS NOT NULL").select("id", "p.*")


@query(
    "prj_07_reanchor",
    """SELECT id, CASE WHEN substring(now, char_start + 1, 9) = snapshot THEN char_start ELSE CAST(list_sort(list_transform(list_filter(range(0, CAST(length(now) AS BIGINT)), lambda i: substring(now, i + 1, 9) = snapshot), lambda i: {'d': abs(i - char_start), 'i': i}))[1].i AS INT) END AS char_start
FROM (SELECT o.*, CASE WHEN char_start % 2 = 0 THEN concat('Well, ', s.text) ELSE s.text END AS now FROM fix_overlay o JOIN fix_segment s ON s.id = o.segment_id) WHERE contains(now, snapshot)""",
)
def _(v: Views) -> DataFrame:
    rows = v.view("fix_overlay").join(v.segments.select(F.col("id").alias("segment_id"), F.col("text").alias("now")), "segment_id")
    now = F.when(F.col("char_start") % 2 == 0, F.concat(F.lit("Well, "), F.col("now"))).otherwise(F.col("now"))
    return rows.select("id", T.reanchor(now, F.col("snapshot"), F.col("char_start"), F.col("char_end")).alias("a")).where("a IS NOT NULL").select("id", "a.char_start")


# ---- planners


_BESIDE = "SELECT *, lead(id) OVER w AS n_id, lead(start_time) OVER w AS n_start, lead(end_time) OVER w AS n_end, lead(inserted) OVER w AS n_ins, lead(rank) OVER w AS n_rank, last_value(CASE WHEN NOT inserted THEN id END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS after_id, first_value(CASE WHEN NOT inserted THEN id END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS before_id FROM own_eff WINDOW w AS (PARTITION BY source_id ORDER BY pos)"


@query(
    "pln_01_time_nudges",
    f"""SELECT id, end_time + 0.125 AS own, CASE WHEN welded THEN n_id END AS other FROM (SELECT *, coalesce(abs(n_start - end_time) < 0.01, false) AS welded FROM ({_BESIDE})) WHERE end_time + 0.125 > start_time AND (NOT welded OR n_start + 0.125 < n_end)""",
)
def _(v: Views) -> DataFrame:
    rows = planners.with_neighbours(v.placed).select("id", planners.plan_time_nudge("end", 0.125).alias("p")).where("p IS NOT NULL")
    return rows.select("id", F.col("p")[0]["new_time"].alias("own"), F.get("p", F.lit(1))["segment_id"].alias("other"))


@query(
    "pln_02_chunk_inserts",
    f"""SELECT id, after_id, CASE WHEN n_id IS NOT NULL THEN before_id END AS before_id, end_time AS start_s, CASE WHEN n_id IS NULL OR gap < 0.01 THEN end_time ELSE n_start END AS end_s,
CASE WHEN lo IS NULL AND hi IS NULL THEN 0 WHEN lo IS NULL THEN hi - 1 WHEN hi IS NULL THEN lo + 1 ELSE (lo + hi) / 2 END AS rank
FROM (SELECT *, n_start - end_time AS gap, CASE WHEN inserted AND abs(start_time - end_time) < 0.01 THEN rank END AS lo, CASE WHEN n_ins AND abs(n_start - end_time) < 0.01 THEN n_rank END AS hi FROM ({_BESIDE})) WHERE after_id IS NOT NULL AND (n_id IS NULL OR gap >= -0.01)""",
)
def _(v: Views) -> DataFrame:
    rows = planners.with_neighbours(v.placed).select("id", planners.plan_chunk_insert().alias("p")).where("p IS NOT NULL")
    return rows.select("id", "p.after_id", "p.before_id", "p.start_s", "p.end_s", "p.rank")


@query(
    "pln_03_chunk_splits",
    f"""SELECT id, after_id, before_id, rtrim(left(text, 12)) AS left_text, ltrim(substring(text, 13)) AS right_text, greatest(start_time + eps, least(end_time - eps, start_time + (end_time - start_time) * (12 / length(text)))) AS split_s
FROM (SELECT *, least(0.01, (end_time - start_time) / 4) AS eps FROM ({_BESIDE})) WHERE end_time > start_time AND length(text) >= 12 AND rtrim(left(text, 12)) <> '' AND ltrim(substring(text, 13)) <> '' AND after_id IS NOT NULL""",
)
def _(v: Views) -> DataFrame:
    rows = projection.with_texts(planners.with_neighbours(v.placed), v.segments, v.edits).where("length(text) >= 12").select("id", planners.plan_chunk_split(F.lit(12)).alias("p")).where("p IS NOT NULL")
    return rows.select("id", "p.after_id", "p.before_id", "p.left_text", "p.right_text", "p.split_s")


@query("pln_04_gates", "SELECT id, CASE k WHEN 0 THEN 'in_progress' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'signed_off' WHEN 3 THEN 'excluded' END AS status, CASE k WHEN 0 THEN 1.5e0 * idx WHEN 1 THEN end_time WHEN 2 THEN 99e0 WHEN 3 THEN 7e0 END AS watermark FROM (SELECT *, idx % 5 AS k FROM fix_segment) WHERE k < 4")
def _(v: Views) -> DataFrame:
    k = F.col("idx") % 5
    raw = F.when(k == 0, F.concat(F.lit(" W  "), F.col("idx") * 1.5)).when(k == 1, "w").when(k == 2, "signoff").when(k == 3, "exclude").otherwise("w soon")
    return v.segments.select("id", planners.plan_gate(raw, F.col("end_time"), F.lit(99.0), F.lit(7.0)).alias("p")).where("p IS NOT NULL").select("id", F.col("p.extraction_status").alias("status"), F.col("p.annotated_through").alias("watermark"))


@query("pln_05_marks", "SELECT id, 'odd' AS mark_class, char_start, CASE WHEN char_start IS NULL THEN '\"no such words\" why' ELSE 'why' END AS note FROM (SELECT id, CASE WHEN idx % 2 = 0 AND text <> '' THEN 0 END AS char_start FROM fix_segment WHERE NOT contains(text, '\"'))")
def _(v: Views) -> DataFrame:
    said = F.when((F.col("idx") % 2 == 0) & (F.col("text") != ""), F.substring("text", 1, 5)).otherwise("no such words")
    raw = F.concat(F.lit(' odd "'), said, F.lit('" why '))
    rows = v.segments.where("NOT contains(text, '\"')").select("id", planners.parse_mark(raw, F.col("text")).alias("p"))
    return rows.select("id", "p.mark_class", "p.char_start", "p.note")


@query("pln_06_mark_menu", "SELECT id, CASE WHEN idx BETWEEN 1 AND 2 THEN concat(CASE idx WHEN 1 THEN 'suspect' ELSE 'false-start' END, ' \"a  b\" x') ELSE concat(idx, ' \"a  b\" x') END AS raw, CASE WHEN idx NOT BETWEEN 1 AND 2 THEN concat('no class #', idx, ' (menu is 1-2)') END AS error FROM fix_segment")
def _(v: Views) -> DataFrame:
    return v.segments.select("id", planners.resolve_mark_class(F.concat(F.col("idx"), F.lit(' "a  b" x')), ["suspect", "false-start"]).alias("p")).select("id", "p.raw", "p.error")


@query("pln_07_entities", "SELECT id, concat('n', idx) AS canonical_name, idx % 2 = 0 AS provisional FROM fix_segment WHERE idx % 3 > 0")
def _(v: Views) -> DataFrame:
    raw = F.when(F.col("idx") % 3 == 0, " ? ").otherwise(F.concat(F.when(F.col("idx") % 2 == 0, " ?? ").otherwise(" "), F.lit("n"), F.col("idx")))
    return v.segments.select("id", planners.parse_entity(raw).alias("p")).where("p IS NOT NULL").select("id", "p.canonical_name", "p.provisional")


@query(
    "pln_08_word_spans",
    f"SELECT id, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS chars, length(regexp_replace(text, '[{WS}]+\\z', ''))::BIGINT AS last_end FROM (SELECT id, text, regexp_extract_all(text, '[^{WS}]+') AS w FROM fix_segment) WHERE len(w) > 0",
)
def _(v: Views) -> DataFrame:
    rows = v.segments.select("id", T.word_spans(F.col("text")).alias("w")).where(F.size("w") > 0)
    chars = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + (x["char_end"] - x["char_start"]))
    return rows.select("id", F.size("w").cast("long").alias("n_words"), chars.alias("chars"), F.element_at("w", -1)["char_end"].cast("long").alias("last_end"))


@query("pln_09_normal_tokens", "SELECT DISTINCT w AS word, regexp_replace(lower(w), '[^\\p{L}\\p{N}]', '', 'g') AS token FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents)")
def _(v: Views) -> DataFrame:
    words = v.sql("SELECT text FROM documents").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return words.select("word", T.normal_token(F.col("word")).alias("token"))


#: Words by place, and for each segment of three or more what a span over all of them has to know; `kind` says which words are aligned.
OWN_VIEWS["own_token"] = f"""
SELECT id, w, a, a + length(w) AS b, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS k FROM (SELECT id, w, i, sum(length(w) + 1) OVER (PARTITION BY id ORDER BY i) - length(w) - 1 AS a FROM (
SELECT id, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM (SELECT id, string_split_regex(text, '[{WS}]') AS p FROM fix_segment WHERE end_time > start_time))) WHERE w <> ''"""
OWN_VIEWS["own_snap"] = """
SELECT s.id, s.start_time, s.end_time, length(s.text) AS len, t.*, CASE WHEN idx % 3 = 1 THEN 'none' WHEN idx % 3 = 2 AND forms = n THEN 'part' ELSE 'all' END AS kind FROM fix_segment s JOIN (
SELECT id AS of, count(*) AS n, count(DISTINCT nullif(regexp_replace(lower(w), '[^\\p{L}\\p{N}]', '', 'g'), '')) AS forms, count(*) FILTER (k % 3 <> 2) AS met, arg_min(a, k) AS a0, arg_max(b, k) AS bl, arg_max(b, k) FILTER (k % 3 <> 2) AS bm, max(a) FILTER (k = 1) AS a1, max(w) FILTER (k = 1) AS w1
FROM own_token GROUP BY 1 HAVING count(*) >= 3) t ON t.of = s.id"""
_AT = "start_time + (end_time - start_time) * {0} / len"


def _snap_input(v: Views) -> DataFrame:
    """Segments of three words or more. One in three has none of them aligned; one in three has all but every third, if no two of its words are the same; the others have all."""
    rows = v.segments.where("end_time > start_time").withColumns({"w": T.word_spans(F.col("text")), "n": F.length("text")}).where(F.size("w") >= 3)
    at = lambda c: F.col("start_time") + (F.col("end_time") - F.col("start_time")) * c / F.col("n")
    timed = lambda words: F.transform(words, lambda x: F.struct(at(x["char_start"]).alias("s"), at(x["char_end"]).alias("e"), x["word"].alias("text")))
    forms = F.filter(F.transform("w", lambda x: T.normal_token(x["word"])), lambda x: x != "")
    differ = F.size(F.array_distinct(forms)) == F.size("w")
    aligned = F.when(F.col("idx") % 3 == 1, F.slice(timed(F.col("w")), 1, 0)).when((F.col("idx") % 3 == 2) & differ, timed(F.filter("w", lambda x, i: i % 3 != 2))).otherwise(timed(F.col("w")))
    return rows.select("id", "text", "start_time", "end_time", F.lit(0).alias("first_word"), (F.size("w") - 1).alias("last_word"), aligned.alias("aligned"), F.col("w")[0]["char_end"].alias("char_end"), F.lit(0).alias("char_start"))


@query(
    "pln_10_snap_words",
    f"""SELECT id, low AS start_s, CASE snap WHEN 'fa-word' THEN {_AT.format("bl")} WHEN 'estimated' THEN greatest(start_time + (end_time - start_time) / len * bl, low + 0.01e0) ELSE greatest(least(end_time, h + (h - low) / greatest(1, bm - a0) * (bl - bm)), low + 0.01e0) END AS end_s, snap, CAST(CASE kind WHEN 'all' THEN n WHEN 'none' THEN 0 ELSE met END AS INT) AS words
FROM (SELECT *, CASE kind WHEN 'none' THEN start_time + (end_time - start_time) / len * a0 ELSE {_AT.format("a0")} END AS low, {_AT.format("bm")} AS h, CASE WHEN kind = 'none' THEN 'estimated' WHEN kind = 'all' OR bm = bl THEN 'fa-word' ELSE 'fa-partial' END AS snap FROM own_snap)""",
)
def _(v: Views) -> DataFrame:
    return FW.snap_words(_snap_input(v)).select("id", "start_s", "end_s", "snap", F.size("words").alias("words"))


@query("pln_11_facing_bounds", f"SELECT id, CASE WHEN kind <> 'none' THEN w1 END AS neighbour_word, CASE WHEN kind <> 'none' THEN {_AT.format('a1')} END AS neighbour_time FROM own_snap")
def _(v: Views) -> DataFrame:
    return FW.facing_bounds(_snap_input(v), "next").select("id", "neighbour_word", "neighbour_time")


@query("pln_12_cursor_windows", "SELECT e.source_id, e.pos, e.id FROM own_eff e JOIN (SELECT source_id, count(*) AS n FROM own_eff GROUP BY 1) c ON c.source_id = e.source_id WHERE pos >= greatest(0, least(greatest(0, c.source_id % 9 - 2), n - 5)) AND pos < greatest(0, least(greatest(0, c.source_id % 9 - 2), n - 5)) + 5")
def _(v: Views) -> DataFrame:
    cursors = v.segments.select("source_id").distinct().withColumn("cursor", F.col("source_id") % 9)
    return planners.cursor_window(v.placed, cursors, 5).select("source_id", "pos", "id")


@query("pln_13_seams", f"SELECT source_id, pos AS left_pos, id AS left_id, n_id AS right_id, greatest(start_time, end_time - 2) AS start_s, least(n_end, n_start + 2) AS end_s, n_start - end_time AS gap_s FROM ({_BESIDE}) WHERE n_id IS NOT NULL")
def _(v: Views) -> DataFrame:
    return planners.seams(v.placed)


@query(
    "pln_14_audio_chunks",
    """SELECT source_id, id, CASE WHEN inserted AND flank IS NOT NULL THEN flank ELSE audio END AS audio_idx, start_time - base AS start_s, end_time - base AS end_s FROM (
SELECT *, last_value(CASE WHEN NOT inserted THEN audio END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS flank FROM (
SELECT e.*, CAST(greatest(0, (SELECT count(*) FROM fix_audio a WHERE a.source_id = e.source_id AND a.start <= e.start_time) - 1) AS INT) AS audio, coalesce((SELECT max(start) FROM fix_audio a WHERE a.source_id = e.source_id AND a.start <= e.start_time), 0) AS base FROM own_eff e))""",
)
def _(v: Views) -> DataFrame:
    return planners.audio_chunks(v.placed, v.view("fix_audio").withColumn("wav_path", F.col("id"))).drop("wav_path")


@query("pln_17_gate_lines", "SELECT source_id, concat(extraction_status, ' · annotated_through ', coalesce(printf('%.1fs', annotated_through), 'none')) AS line FROM own_gate")
def _(v: Views) -> DataFrame:
    return overlay.latest_gates(v.gates).select("source_id", planners.gate_line().alias("line"))


# ---- commands


@query(
    "cmd_01_run_summary",
    f"""SELECT s.source_id, s.segments, s.empty_segments, coalesce(f.n, 0) AS flagged, coalesce(p.n, 0) AS pruned, coalesce(e.n, 0) AS effective_segments
FROM (SELECT source_id, count(*) AS segments, count(*) FILTER (NOT regexp_matches(text, '[^{WS}]')) AS empty_segments FROM fix_segment GROUP BY 1) s
LEFT JOIN (SELECT source_id, count(*) AS n FROM own_flag WHERE concat_ws(',', f1, f2, f3, f4) <> '' GROUP BY 1) f ON f.source_id = s.source_id
LEFT JOIN (SELECT source_id, count(*) AS n FROM fix_segment WHERE text = '' GROUP BY 1) p ON p.source_id = s.source_id
LEFT JOIN (SELECT source_id, count(*) AS n FROM own_eff GROUP BY 1) e ON e.source_id = s.source_id""",
)
def _(v: Views) -> DataFrame:
    return stats.run_summary(v.segments, signals.signal_flags(v.segments), v.effective, selectors.empty_segments(v.segments))


@query("cmd_03_review_sheet", "SELECT * FROM (SELECT f.id, concat_ws(',', f1, f2, f3, f4, CASE WHEN d.id IS NOT NULL THEN 'transcriber-divergence' END) AS flags, coalesce(t.new_text, f.text) AS text, d.vtext AS variant_text FROM own_flag f LEFT JOIN own_said t ON t.segment_id = f.id LEFT JOIN own_diverge d ON d.id = f.id) WHERE flags <> ''")
def _(v: Views) -> DataFrame:
    sheet = commands.review_sheet(v.segments, v.corrections, v.superseded, _variants(v))
    return sheet.select("id", F.array_join("flags", ",").alias("flags"), "text", "variant_text")


@query("pln_18_worklist_lines", "SELECT f.id, concat('#', f.idx, ' [', concat_ws(', ', f1, f2, f3, f4, CASE WHEN d.id IS NOT NULL THEN 'transcriber-divergence' END), ']', chr(10), '  text:    ', coalesce(t.new_text, f.text), CASE WHEN d.vtext IS NULL THEN '' ELSE concat(chr(10), '  variant: ', d.vtext) END) AS line FROM own_flag f LEFT JOIN own_said t ON t.segment_id = f.id LEFT JOIN own_diverge d ON d.id = f.id WHERE concat_ws(',', f1, f2, f3, f4, d.id) <> ''")
def _(v: Views) -> DataFrame:
    return commands.review_sheet(v.segments, v.corrections, v.superseded, _variants(v)).select("id", planners.worklist_line().alias("line"))


@query("cmd_04_prune_plan", "SELECT source_id, count(*)::INT AS pruned_count, string_agg(id, ',' ORDER BY idx) AS ids FROM fix_segment WHERE text = '' GROUP BY 1")
def _(v: Views) -> DataFrame:
    return commands.prune_plan(v.segments).select("source_id", "pruned_count", F.array_join("pruned_segment_ids", ",").alias("ids"))


@query("cmd_08_stats_by_purpose", "SELECT CASE WHEN coalesce(purpose, '') = '' THEN 'genuine' ELSE purpose END AS purpose, correction_type AS name, count(*) AS n FROM own_live o LEFT JOIN fix_session s ON s.session_id = o.session_id GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return stats.stats_by_purpose(v.corrections, v.superseded, v.sessions).where("kind = 'op'").groupBy("purpose", "name").agg(F.sum("n").alias("n"))


@query("cmd_08_label_spotlight", "SELECT source_id, count(*) FILTER (operation = 'chunk_insert' AND label = 'inhale') AS inserts, count(*) FILTER (operation = 'mark' AND mark_class = 'inhale') AS marks FROM own_live GROUP BY 1")
def _(v: Views) -> DataFrame:
    return stats.label_spotlight(v.corrections, v.superseded, "inhale")


@query(
    "cmd_09_gate_table",
    "SELECT coalesce(s.source_id, g.source_id) AS source_id, s.segments, s.end_s, g.extraction_status, g.annotated_through FROM (SELECT source_id, count(*) AS segments, max(end_time) AS end_s FROM fix_segment GROUP BY 1) s FULL JOIN (SELECT * FROM own_gate UNION ALL SELECT source_id + 10000000, extraction_status, annotated_through FROM own_gate WHERE source_id % 5 = 0) g ON g.source_id = s.source_id",
)
def _(v: Views) -> DataFrame:
    none = F.lit(None).cast("string")
    spineless = v.gates.where("source_id % 5 = 0").withColumn("source_id", F.col("source_id") + 10000000)
    table = commands.gate_table(v.segments.withColumns({"skeleton_hash": none, "split_policy": none}), v.gates.unionByName(spineless))
    return table.select("source_id", "segments", "end_s", "extraction_status", "annotated_through")


@query(
    "cmd_12_transfer_plan",
    """SELECT d.source_id, d.insert_id, CASE WHEN dup THEN 'duplicate' WHEN a.id IS NULL THEN 'unanchored' ELSE 'transfer' END AS status, CASE WHEN NOT dup THEN a.id END AS after_id, CASE WHEN NOT dup THEN a.n_id END AS before_id FROM (
  SELECT e.source_id, e.id AS insert_id, e.label, e.start_time, EXISTS (SELECT 1 FROM own_eff t WHERE t.source_id = e.source_id AND t.inserted AND t.idx % 2 = 1 AND t.label = e.label AND abs(t.start_time - e.start_time) <= 0.15) AS dup FROM own_eff e WHERE e.inserted AND e.label <> '' AND trim(e.text) = '' AND e.idx % 2 = 0) d
ASOF LEFT JOIN (SELECT *, lead(id) OVER (PARTITION BY source_id ORDER BY idx) AS n_id FROM fix_segment WHERE idx % 2 = 1) a ON a.source_id = d.source_id AND a.start_time <= d.start_time""",
)
def _(v: Views) -> DataFrame:
    effective = v.effective
    donors = transfer.wordless_donors(effective.where("idx % 2 = 0"))
    return transfer.transfer_plan(donors, effective.where("idx % 2 = 1"), v.segments.where("idx % 2 = 1")).select("source_id", "insert_id", "status", "after_id", "before_id")


@query("cmd_13_export_proposals", "SELECT source_id, label, round(start_time, 4) AS start_time, round(end_time, 4) AS end_time, rank AS score, CAST(1 AS INT) AS tier FROM own_eff WHERE inserted AND label <> '' AND trim(text) = ''")
def _(v: Views) -> DataFrame:
    return commands.proposal_rows(transfer.wordless_donors(v.placed)).drop("proposal_id")


@query(
    "cmd_14_mishomed_words",
    """SELECT w.source_id, w.s, w.e, w.text FROM fix_gap_word w WHERE w.e > w.s AND coalesce((SELECT max(least(w.e, c.end_time) - greatest(w.s, c.start_time)) FROM fix_segment c WHERE c.source_id = w.source_id AND c.end_time > c.start_time AND c.start_time < w.e AND c.end_time > w.s), 0) < 0.01""",
)
def _(v: Views) -> DataFrame:
    return transfer.mishomed_words(v.view("fix_gap_word"), v.segments, 0.01).drop("copies")


@query(
    "cmd_14_scan_mishomed",
    """SELECT source_id, prev_idx, next_idx, count(*) AS words, string_agg(text, ' ' ORDER BY s, e, text) AS text, min(s) AS start_s FROM (
SELECT *, sum(CASE WHEN prev_idx IS NOT DISTINCT FROM lag_p AND next_idx IS NOT DISTINCT FROM lag_n THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY s, e, text ROWS UNBOUNDED PRECEDING) AS inst FROM (
SELECT *, lag(prev_idx) OVER w AS lag_p, lag(next_idx) OVER w AS lag_n FROM (
SELECT w.*, coalesce((SELECT arg_max(idx, (end_time, -start_time, -idx)) FROM fix_segment c WHERE c.source_id = w.source_id AND c.end_time <= w.s + 0.02), -1) AS prev_idx, coalesce((SELECT arg_min(idx, (start_time, idx)) FROM fix_segment c WHERE c.source_id = w.source_id AND c.start_time >= w.e - 0.02), -1) AS next_idx
FROM fix_gap_word w WHERE w.e > w.s AND coalesce((SELECT max(least(w.e, c.end_time) - greatest(w.s, c.start_time)) FROM fix_segment c WHERE c.source_id = w.source_id AND c.end_time > c.start_time AND c.start_time < w.e AND c.end_time > w.s), 0) < 0.01)
WINDOW w AS (PARTITION BY source_id ORDER BY s, e, text))) GROUP BY source_id, prev_idx, next_idx, inst""",
)
def _(v: Views) -> DataFrame:
    found = transfer.scan_mishomed(v.view("fix_gap_word"), v.segments, None, 0.01)
    return found.select("source_id", "prev_idx", "next_idx", "words", "text", "start_s")


OWN_VIEWS["own_homeless"] = """
SELECT *, sum(CASE WHEN prev_idx IS NOT DISTINCT FROM lag_p AND next_idx IS NOT DISTINCT FROM lag_n THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY s, e, text ROWS UNBOUNDED PRECEDING)::BIGINT AS instance FROM (
SELECT *, lag(prev_idx) OVER w AS lag_p, lag(next_idx) OVER w AS lag_n FROM (
SELECT w.*, coalesce(p.idx, -1) AS prev_idx, coalesce(n.idx, -1) AS next_idx, coalesce(p.at, 0e0) AS gap_start, n.at AS gap_end FROM (
  SELECT x.*, (SELECT arg_max({'idx': idx, 'at': end_time}, (end_time, -start_time, -idx)) FROM fix_segment c WHERE c.source_id = x.source_id AND c.end_time <= x.s + 0.02) AS p, (SELECT arg_min({'idx': idx, 'at': start_time}, (start_time, idx)) FROM fix_segment c WHERE c.source_id = x.source_id AND c.start_time >= x.e - 0.02) AS n
  FROM fix_gap_word x WHERE x.e > x.s AND coalesce((SELECT max(least(x.e, c.end_time) - greatest(x.s, c.start_time)) FROM fix_segment c WHERE c.source_id = x.source_id AND c.end_time > c.start_time AND c.start_time < x.e AND c.end_time > x.s), 0) < 0.01) w)
WINDOW w AS (PARTITION BY source_id ORDER BY s, e, text))"""
OWN_VIEWS["own_instance"] = "SELECT source_id, instance, prev_idx, next_idx, count(*) AS words, string_agg(text, ' ' ORDER BY s, e, text) AS text, min(s) AS start_s, arg_max(e, (s, e)) AS end_s, any_value(gap_start) AS gap_start, any_value(gap_end) AS gap_end FROM own_homeless GROUP BY ALL"


@query(
    "cmd_14_scan_mechanisms",
    f"""SELECT i.source_id, i.instance, prev_idx, next_idx, words, text, start_s, end_s, CASE WHEN gap_end IS NULL OR coalesce(bare, 0) >= {transfer.UNCOVERED} THEN 'vad-gap' ELSE 'carve-sliver' END AS mechanism FROM own_instance i LEFT JOIN (
SELECT source_id, instance, max(free) AS bare FROM (WITH met AS (SELECT i.source_id, i.instance, gap_end - gap_start AS w, greatest(0, p.start_time - gap_start) AS s, least(gap_end, p.end_time) - gap_start AS e FROM own_instance i JOIN fix_proposal p ON p.source_id = i.source_id AND p.end_time > p.start_time AND p.start_time < gap_end AND p.end_time > gap_start WHERE gap_end > gap_start)
  SELECT source_id, instance, s - coalesce(max(e) OVER (PARTITION BY source_id, instance ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free FROM met
  UNION ALL SELECT source_id, instance, gap_end - gap_start - coalesce((SELECT max(e) FROM met m WHERE m.source_id = i.source_id AND m.instance = i.instance), 0) FROM own_instance i WHERE gap_end > gap_start) GROUP BY 1, 2) b ON b.source_id = i.source_id AND b.instance = i.instance""",
)
def _(v: Views) -> DataFrame:
    return transfer.scan_mishomed(v.view("fix_gap_word"), v.segments, v.view("fix_proposal"), 0.01)


# ---- intervals, change log, view


@query("int_01_overlap_join", "SELECT a.id, t.turn_start, t.turn_end, t.speaker FROM fix_segment a JOIN fix_turn t ON t.source_id = a.source_id AND t.turn_start < a.end_time AND t.turn_end > a.start_time WHERE a.end_time > a.start_time")
def _(v: Views) -> DataFrame:
    return intervals.overlap_join(v.segments, v.view("fix_turn"), ["source_id"], ("start_time", "end_time"), ("turn_start", "turn_end")).select("id", "turn_start", "turn_end", "speaker")


def _journal(v: Views) -> DataFrame:
    """fix_op as lines of a change log, every tenth one twice."""
    line = F.to_json(F.struct(F.array(F.struct("*")).alias("correction")))
    verb = F.when(F.col("operation") == "replace_text", "text-correction").when(F.col("operation") == "time_nudge", "time-nudge").when(F.col("operation") == "chunk_insert", "chunk-insert").when(F.col("operation") == "mark", "mark").otherwise("speaker-assign")
    none = F.lit(None).cast("string")
    rows = v.corrections.select(verb.alias("verb"), "actor", F.col("session_id").alias("set"), none.alias("args"), line.alias("wires"), "id", none.alias("anchor"), "seq")
    return rows.unionByName(rows.where("seq % 10 = 0")).drop("seq")


@query("str_01_live_counts", "SELECT CAST(floor(created_at / 3600) * 3600 AS BIGINT) AS window_start, CASE operation WHEN 'replace_text' THEN 'text-correction' WHEN 'time_nudge' THEN 'time-nudge' WHEN 'chunk_insert' THEN 'chunk-insert' WHEN 'mark' THEN 'mark' ELSE 'speaker-assign' END AS verb, sum(CASE WHEN seq % 10 = 0 THEN 2 ELSE 1 END)::BIGINT AS ops FROM fix_op GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return journal.live_counts(_journal(v)).withColumn("window_start", F.unix_timestamp("window_start"))


@query("str_02_replay", "SELECT id, source_id, correction_type, status, created_at FROM fix_op")
def _(v: Views) -> DataFrame:
    return journal.replay(_journal(v))["correction"].select("id", F.col("source_id").cast("long").alias("source_id"), "correction_type", "status", "created_at")


def _whole_journal(v: Views) -> DataFrame:
    """Sessions that begin and change, entities with a new name, gates and edges, each as lines of a change log; every third line twice."""
    none = F.lit(None).cast("string")
    line = lambda df, verb, table: df.select(F.lit(verb).alias("verb"), F.lit("human").alias("actor"), none.alias("set"), none.alias("args"), F.to_json(F.struct(F.array(F.struct("*")).alias(table))).alias("wires"), none.alias("id"), none.alias("anchor"), F.col("seq").alias("n"))
    s = v.view("fix_session").select(F.col("session_id").alias("id"), F.lit("in_progress").alias("status"), "purpose", F.array(F.lit("a")).alias("scope"), F.lit(1.0).alias("started_at"), F.lit(1.0).alias("updated_at"), F.substring("session_id", 2, 9).cast("long").alias("seq"))
    done = s.where("seq % 2 = 0").withColumns({"status": F.lit("completed"), "updated_at": F.lit(2.0), "seq": F.col("seq") + 1})
    gates, edges = v.gates.withColumns({"source_id": F.col("source_id").cast("string"), "session_id": none, "actor": none}), _review_edges(v).withColumn("id", F.concat(F.lit("x"), F.col("seq")))
    rows = line(s, "session-start", "session").unionByName(line(done, "session-status", "session")).unionByName(line(gates, "extraction-gate", "gate")).unionByName(line(edges, "review-markers", "edge"))
    return rows.unionByName(rows.where("n % 3 = 0")).drop("n")


@query("str_02_replay_sessions", "SELECT session_id AS id, CASE WHEN CAST(substring(session_id, 2) AS INT) % 2 = 0 THEN 'completed' ELSE 'in_progress' END AS status, purpose FROM fix_session")
def _(v: Views) -> DataFrame:
    return journal.replay(_whole_journal(v))["session"].select("id", "status", "purpose")


@query("str_02_replay_gates", "SELECT id, CAST(source_id AS VARCHAR) AS source_id, extraction_status, annotated_through FROM fix_gate")
def _(v: Views) -> DataFrame:
    return journal.replay(_whole_journal(v))["gate"].select("id", "source_id", "extraction_status", "annotated_through")


@query("str_02_replay_edges", "SELECT concat('x', seq) AS id, session_id AS source_id, segment_id AS target_id, decision FROM fix_review")
def _(v: Views) -> DataFrame:
    return journal.replay(_whole_journal(v))["edge"].select("id", "source_id", "target_id", "decision")


@query("str_03_anchors", "SELECT 'd' || s.source_id AS id, concat('h', s.source_id % 50) AS content_hash, row_number() OVER (PARTITION BY s.source_id ORDER BY idx) - 1 AS n, idx, start_time, end_time, text FROM fix_segment s")
def _(v: Views) -> DataFrame:
    src = v.view("fix_source").select(F.col("source_id").alias("id"), "content_hash")
    rows = readers.segment_anchor(v.segments, src, v.segments.select("id")).select(F.concat(F.lit("d"), F.col("source_id")).alias("id"), "content_hash", F.posexplode("segments").alias("n", "s"))
    return rows.select("id", "content_hash", F.col("n").cast("long").alias("n"), "s.*")


@query("cmd_11_session_activity", "SELECT session_id, sum(CASE WHEN seq % 10 = 0 THEN 2 ELSE 1 END)::BIGINT AS ops, min(created_at) AS first_ts, max(created_at) AS last_ts FROM fix_op GROUP BY 1")
def _(v: Views) -> DataFrame:
    return journal.activity(_journal(v)).drop("seconds")


@query(
    "viw_03_view",
    """SELECT e.source_id, e.pos, e.id, e.text, e.inserted AS is_inserted, e.id IN (SELECT segment_id FROM own_pruned) AS is_pruned, m.classes IS NOT NULL AS is_marked, m.classes AS mark_classes,
  EXISTS (SELECT 1 FROM fix_overlay o WHERE o.segment_id = e.id AND o.id NOT IN (SELECT target_id FROM fix_dropped)) AS has_overlay, a.entity_id, g.members AS split_group
FROM own_veff e LEFT JOIN (SELECT segment_id, array_to_string(list_sort(list(DISTINCT mark_class)), ',') AS classes FROM own_live WHERE operation = 'mark' GROUP BY 1) m ON m.segment_id = e.id
LEFT JOIN (SELECT segment_id, entity_id FROM own_live WHERE operation = 'speaker_assign' QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY created_at DESC, seq DESC) = 1) a ON a.segment_id = e.id
LEFT JOIN (SELECT substring(rationale, 13) AS insert_id, string_agg(id, ',' ORDER BY id) AS members FROM own_live WHERE rationale LIKE 'chunk-split:%' GROUP BY 1) g ON g.insert_id = e.id""",
)
def _(v: Views) -> DataFrame:
    frame = commands.spine_view(v.segments, v.all_corrections, v.dropped)
    return frame.select("source_id", "pos", "id", "text", "is_inserted", "is_pruned", "is_marked", F.array_join("mark_classes", ",").alias("mark_classes"), "has_overlay", "entity_id", F.array_join("split_group", ",").alias("split_group"))



from palimpsest.catalog import writes  # noqa: E402, F401 - registers the queries of the writers
