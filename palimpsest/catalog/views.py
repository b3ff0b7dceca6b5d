"""Transcript tables derived from the test tables. Each view is one SQL text for Spark and DuckDB alike, but for splitting lines.

In Spark, views that many others start from are read as tables."""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.lineage import cut, on_path
from palimpsest.schemas import PAYLOAD_FIELDS

LINES = {
    "spark": r"SELECT doc_id AS source_id, p.idx, p.line FROM documents LATERAL VIEW posexplode(split(text, '\n')) p AS idx, line",
    "duckdb": "SELECT doc_id AS source_id, CAST(i-1 AS INT) AS idx, list_extract(string_split(text, chr(10)), i) AS line FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10)))+1)) AS i)",
}

VIEWS = {
    "fix_source": "SELECT concat('d', doc_id) AS id, doc_id AS source_id, CASE WHEN doc_id % 7 <> 0 THEN concat(lang, ' ', source, ' ', doc_id) END AS title, concat('h', doc_id % 50) AS content_hash FROM documents",
    "fix_segment": """
SELECT concat('s', source_id, '-', idx) AS id, source_id, idx, CASE WHEN idx % 7 = 3 THEN '' ELSE line END AS text,
       cs / 16e0 AS start_time, (cs + length(line)) / 16e0 AS end_time
FROM (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY source_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cs FROM fix_line)""",
    "fix_variant": """
SELECT id AS segment_id, source_id, 'b' AS transcriber,
       CASE WHEN idx % 5 = 0 THEN concat(text, '!') WHEN idx % 11 = 0 THEN concat(text, ' extra') ELSE text END AS vtext
FROM fix_segment""",
    "fix_event": "SELECT event_id AS seq, user_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, (event_id * 7919) % (SELECT count(*) FROM documents) AS source_id FROM events",
    "fix_correction": """
SELECT concat('c', e.seq) AS id, e.seq, CAST(e.seq AS DOUBLE) AS created_at, concat('u', e.user_id) AS session_id,
       e.source_id, s.id AS segment_id, e.k,
       CASE e.event_type WHEN 'click' THEN 'text_content' WHEN 'view' THEN 'timing' WHEN 'signup' THEN 'insertion'
            WHEN 'purchase' THEN 'mark' ELSE 'speaker' END AS correction_type,
       CASE WHEN e.k % 13 = 0 THEN 'proposed' ELSE 'applied' END AS status,
       CASE WHEN e.event_type = 'click' THEN concat(s.text, ' v', e.seq) END AS new_text,
       CASE WHEN e.event_type = 'view' THEN CASE WHEN e.k % 2 = 0 THEN 'end' ELSE 'start' END END AS edge,
       CASE WHEN e.event_type = 'view' THEN CASE WHEN e.k % 2 = 0 THEN s.end_time ELSE s.start_time END + (e.k % 5) / 64e0 END AS new_time,
       CASE WHEN e.event_type = 'signup' THEN s.end_time END AS ins_start,
       CASE WHEN e.event_type = 'signup' THEN s.end_time + (e.k % 4) / 16e0 END AS ins_end,
       CASE WHEN e.event_type = 'signup' THEN CASE e.k % 4 WHEN 1 THEN 'inhale' WHEN 2 THEN 'click' WHEN 3 THEN 'hesitation-marker' END END AS label,
       CASE WHEN e.event_type = 'purchase' THEN CASE e.k % 3 WHEN 0 THEN 'suspect' WHEN 1 THEN 'false-start' ELSE 'voiced-quote' END END AS mark_class,
       CASE WHEN e.event_type = 'error' THEN concat('e', e.k % 5) END AS entity_id
FROM fix_event e JOIN (SELECT source_id, count(*) AS n FROM fix_segment GROUP BY source_id) c ON c.source_id = e.source_id
JOIN fix_segment s ON s.source_id = e.source_id AND s.idx = e.k % c.n""",
    "fix_supersedes": """
SELECT id AS superseder_id, target_id FROM (SELECT id, k, lag(id) OVER (PARTITION BY source_id, correction_type ORDER BY seq) AS target_id
FROM fix_correction) WHERE k % 5 = 0 AND target_id IS NOT NULL""",
    "fix_session": "SELECT DISTINCT concat('u', user_id) AS session_id, CASE WHEN user_id % 5 = 0 THEN 'feature-test' WHEN user_id % 7 = 0 THEN '' END AS purpose FROM events",
    "fix_gate": """
SELECT concat('g', l.doc_id, '-', r.rev) AS id, l.doc_id AS source_id, CAST(r.rev AS DOUBLE) AS created_at,
       CASE WHEN r.rev = 0 THEN 'in_progress' WHEN l.toxic = 1 THEN 'excluded' WHEN l.quality = 1 THEN 'signed_off' ELSE 'in_progress' END AS extraction_status,
       CASE WHEN l.doc_id % 4 <> 0 THEN m.e / (2 - r.rev) END AS annotated_through
FROM labels l JOIN (SELECT source_id, max(end_time) AS e FROM fix_segment GROUP BY source_id) m ON m.source_id = l.doc_id
CROSS JOIN (SELECT 0 AS rev UNION ALL SELECT 1) r""",
    "fix_turn": "SELECT source_id, (seq % 997) / 16e0 AS turn_start, (seq % 997) / 16e0 + (k % 40 + 1) / 8e0 AS turn_end, concat('SPK_', user_id % 4) AS speaker FROM fix_event",
    "fix_proposal": """
SELECT concat('p', seq) AS proposal_id, source_id, CASE WHEN k % 9 = 0 THEN 'inhale' ELSE coalesce(label, 'click') END AS label,
       ins_start + (k % 7 - 3) / 16e0 AS start_time, ins_end + (k % 7 - 3) / 16e0 + 1 / 16e0 AS end_time, CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END AS tier
FROM fix_correction WHERE correction_type = 'insertion' AND ins_start > 0.5e0""",
    # the whole overlay, flat: what fix_correction has, and texts, nudges and splits of its inserts, inserts before a segment, ranks
    "fix_op": """
SELECT id, seq * 4 AS seq, created_at, session_id, source_id, correction_type,
       CASE correction_type WHEN 'text_content' THEN 'replace_text' WHEN 'timing' THEN 'time_nudge' WHEN 'insertion' THEN 'chunk_insert' WHEN 'mark' THEN 'mark' ELSE 'speaker_assign' END AS operation,
       status, CASE WHEN correction_type = 'insertion' AND k % 10 = 7 THEN 'chunk-split' END AS rationale,
       CASE WHEN correction_type <> 'insertion' THEN segment_id END AS segment_id, new_text, edge, new_time,
       CASE WHEN correction_type = 'insertion' THEN CASE WHEN k % 11 = 0 THEN 'nowhere' ELSE segment_id END END AS after_id,
       CASE WHEN correction_type = 'insertion' AND k % 11 = 0 THEN segment_id END AS before_id, ins_start, ins_end,
       CASE WHEN correction_type = 'insertion' THEN CASE WHEN k % 10 = 7 THEN concat('half ', seq) ELSE '' END END AS body, label,
       CASE WHEN correction_type = 'insertion' THEN (k % 3) / 2e0 END AS rank, mark_class, entity_id
FROM fix_correction
UNION ALL
SELECT concat('ct', seq), seq * 4 + 1, created_at + 0.25e0, session_id, source_id, 'text_content', 'replace_text', CASE WHEN k % 16 = 0 THEN 'proposed' ELSE 'applied' END,
       CASE WHEN k % 10 = 7 THEN concat('chunk-split:', id) END, id, concat('said ', seq), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM fix_correction WHERE correction_type = 'insertion' AND k % 8 < 2
UNION ALL
SELECT concat('cn', seq), seq * 4 + 2, created_at + 0.5e0, session_id, source_id, 'timing', 'time_nudge', 'applied',
       CASE WHEN k % 10 = 7 THEN concat('chunk-split:', id) END, id, NULL, CASE WHEN k % 2 = 0 THEN 'start' ELSE 'end' END, CASE WHEN k % 2 = 0 THEN ins_start - 2 / 16e0 ELSE ins_end + 3 / 16e0 END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM fix_correction WHERE correction_type = 'insertion' AND k % 6 < 2""",
    # one prune for every third source, of its empty segments with an even idx; one source in twelve names a segment that it lacks, too
    "fix_pruned": """
SELECT concat('x', source_id) AS id, source_id, id AS segment_id FROM fix_segment WHERE source_id % 3 = 0 AND text = '' AND idx % 2 = 0
UNION ALL
SELECT DISTINCT concat('x', source_id), source_id, 'elsewhere' FROM fix_segment WHERE source_id % 12 = 0 AND text = '' AND idx % 2 = 0""",
    # speech overlays on spans of segments with some length
    "fix_overlay": """
SELECT concat('o', c.seq) AS id, c.seq * 4 + 3 AS seq, c.created_at + 0.75e0 AS created_at, c.session_id, c.source_id, c.segment_id, concat('voice-', c.k % 3) AS label,
       c.k % 5 AS char_start, c.k % 5 + 9 AS char_end, substring(s.text, c.k % 5 + 1, 9) AS snapshot,
       s.start_time + (c.k % 5) / 16e0 AS start_time, CASE WHEN c.k % 17 <> 0 THEN s.start_time + (c.k % 5 + 9) / 16e0 END AS end_time
FROM fix_correction c JOIN fix_segment s ON s.id = c.segment_id WHERE c.correction_type = 'mark' AND c.k % 2 = 0 AND length(s.text) > 20""",
    "fix_dropped": """
SELECT target_id FROM fix_supersedes
UNION ALL SELECT concat('o', seq) FROM fix_correction WHERE correction_type = 'mark' AND k % 14 = 0""",
    # boundaries with an even idx in front: a push of the last word over every other one, a pull of the first word over the rest
    "fix_shift": r"""
SELECT concat('b', a.source_id, '-', a.idx) AS id, a.source_id, a.id AS left_id, b.id AS right_id, CASE WHEN a.idx % 4 = 0 THEN 'push' ELSE 'pull' END AS direction,
       CASE WHEN a.idx % 4 = 0 THEN regexp_extract(a.text, '([^ ]+) *$', 1) ELSE regexp_extract(b.text, '^ *([^ ]+)', 1) END AS moved
FROM fix_segment a JOIN fix_segment b ON b.source_id = a.source_id AND b.idx = a.idx + 1 WHERE a.idx % 2 = 0 AND CASE WHEN a.idx % 4 = 0 THEN a.text ELSE b.text END LIKE '%_ _%'""",
    "fix_audio": "SELECT concat('a', source_id, '-', n) AS id, source_id, CAST(n AS INT) AS idx, n * 40e0 AS start, (n + 1) * 40e0 AS end_ FROM (SELECT DISTINCT source_id, CAST(floor(start_time / 40e0) AS BIGINT) AS n FROM fix_segment)",
    "fix_spine": """
SELECT *, CASE idx % 3 WHEN 1 THEN concat('sha256:', md5(concat('a', source_id))) WHEN 2 THEN concat('sha256:', md5(concat('b', source_id))) END AS skeleton_hash,
       CASE WHEN idx % 5 = 0 THEN '' WHEN idx % 3 = 0 THEN NULL ELSE concat('policy-', idx % 3) END AS split_policy FROM fix_segment""",
    "fix_review": "SELECT session_id, segment_id, CASE k % 4 WHEN 0 THEN 'unreviewed' WHEN 1 THEN 'approved' WHEN 2 THEN 'corrected' ELSE 'skipped' END AS decision, created_at AS ts, seq FROM fix_correction",
    "fix_rendition": """
SELECT concat('r', doc_id, '-', n) AS id, doc_id AS source_id, CASE n WHEN 0 THEN '' WHEN 1 THEN 'denoise' ELSE 'denoise|vocals' END AS chain_text, n = 0 AS is_raw, CASE n WHEN 1 THEN 'Denoised' WHEN 2 THEN 'Vocals only' END AS preprocessing
FROM documents CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2) x""",
    # a recording's words as its alignment has them, some moved out of every chunk
    "fix_word": """
SELECT source_id, id AS segment_id, start_time + (end_time - start_time) / 4e0 + CASE WHEN idx % 9 = 4 THEN 4096e0 ELSE 0e0 END AS s, start_time + (end_time - start_time) / 2e0 + CASE WHEN idx % 9 = 4 THEN 4096e0 ELSE 0e0 END AS e, concat('w', idx) AS text
FROM fix_segment WHERE end_time > start_time""",
    "fix_gap_word": """
SELECT source_id, start_time - 1 / 32e0 AS s, start_time - 1 / 64e0 AS e, concat('g', idx) AS text FROM fix_segment WHERE idx % 6 = 5 AND idx > 0
UNION ALL SELECT source_id, s, e, text FROM fix_word""",
}


#: Decisions, in one SQL text for both engines; arrays and structs are put together on either side.
STAMP = "source_id, session_id, created_at, seq"
DECIDED = {
    "fix_d_prune": "SELECT concat('p', source_id) AS id, source_id, 'u0' AS session_id, 1e0 AS created_at, 1 AS seq, array_agg(id) AS segment_ids FROM fix_segment WHERE text = '' GROUP BY source_id",
    "fix_d_text": f"SELECT concat('t', seq) AS id, {STAMP}, segment_id, new_text, concat('was ', seq) AS old_text, CASE WHEN k % 3 = 0 THEN concat('c', seq) END AS supersedes_id, CASE WHEN k % 7 = 0 THEN 'model' ELSE 'human' END AS actor FROM fix_correction WHERE correction_type = 'text_content'",
    "fix_d_shift": f"SELECT concat('b', seq) AS id, {STAMP}, segment_id AS left_id, concat(segment_id, 'r') AS right_id, concat('w', k) AS text, CASE k % 3 WHEN 0 THEN 'push' WHEN 1 THEN 'pull' ELSE 'sideways' END AS direction FROM fix_correction WHERE correction_type = 'timing'",
    "fix_d_reject": f"SELECT concat('r', seq) AS id, {STAMP}, id AS rejected_id, CASE WHEN k % 4 = 0 THEN concat('g', seq) END AS member FROM fix_correction",
    "fix_d_mark": f"SELECT concat('m', seq) AS id, {STAMP}, CASE k % 4 WHEN 0 THEN 'segment' WHEN 1 THEN 'boundary' WHEN 2 THEN 'span' ELSE 'page' END AS kind, segment_id, CASE WHEN k % 8 < 4 THEN concat(segment_id, 'r') END AS right_id, k AS char_start, k + 3 AS char_end, CASE WHEN k % 5 > 0 THEN concat('said ', k) END AS snapshot, CASE WHEN k % 6 = 0 THEN ' -odd' ELSE concat('  ', mark_class, ' ') END AS mark_class FROM fix_correction WHERE correction_type = 'mark'",
    "fix_d_nudge": f"SELECT concat('n', seq) AS id, {STAMP}, segment_id, CASE WHEN k % 9 = 0 THEN 'middle' ELSE edge END AS edge, new_time, CASE WHEN k % 2 = 0 THEN concat(segment_id, 'r') END AS other_id FROM fix_correction WHERE correction_type = 'timing'",
    "fix_d_insert": f"SELECT concat('i', seq) AS id, {STAMP}, segment_id AS after_id, CASE WHEN k % 2 = 0 THEN concat(segment_id, 'r') END AS before_id, ins_start AS start_time, ins_end - (k % 3) / 16e0 AS end_time, CASE WHEN k % 3 > 0 THEN '' END AS text, label, (k % 3) / 2e0 AS rank FROM fix_correction WHERE correction_type = 'insertion'",
    "fix_d_split": f"SELECT concat('s', seq) AS id, {STAMP}, segment_id, ins_start - (k % 5) / 16e0 AS split_time, ins_start AS end_time, CASE WHEN k % 6 = 0 THEN ' ' ELSE concat('left ', k) END AS left_text, concat('right ', k) AS right_text, concat('was ', k) AS old_text, segment_id AS after_id, concat(segment_id, 'r') AS before_id FROM fix_correction WHERE correction_type = 'insertion'",
    "fix_d_assign": f"SELECT concat('a', seq) AS id, {STAMP}, segment_id, CASE WHEN k % 2 = 0 THEN concat(segment_id, 'r') END AS other_id, CASE WHEN k % 11 > 0 THEN entity_id ELSE '' END AS entity_id, CASE k % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'accept' ELSE 'guess' END AS verdict FROM fix_correction WHERE correction_type = 'speaker'",
    "fix_d_voice": f"SELECT concat('v', seq) AS id, {STAMP}, segment_id, char_start, char_end, snapshot, CASE WHEN seq % 3 = 0 THEN '' ELSE label END AS label, start_time, end_time, CASE WHEN seq % 5 = 0 THEN '  ' ELSE snapshot END AS text FROM fix_overlay",
    "fix_d_gate": "SELECT concat('n', id) AS id, source_id, 'u0' AS session_id, created_at, CAST(created_at AS BIGINT) AS seq, CASE WHEN source_id % 9 = 0 THEN 'done' ELSE extraction_status END AS extraction_status, annotated_through - CASE WHEN source_id % 7 = 0 THEN 100000e0 ELSE 0e0 END AS annotated_through FROM fix_gate",
}


def with_views(dialect: str, sql: str, tables: str = "", more: dict[str, str] | None = None) -> str:
    """A query with the views that it needs in front of it; `tables` are definitions that come first, `more` other views by name."""
    known = VIEWS | DECIDED | {"fix_line": LINES[dialect]} | (more or {})
    needed: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\b(?:fix|own)_\w+", text):
            if name in known and name not in needed:
                need(known[name])
                needed.append(name)

    need(sql)
    parts = [*([tables] if tables else []), *(f"{n} AS ({known[n]})" for n in needed)]
    head = ",\n".join(parts)
    return f"WITH {head}\n{sql}" if head else sql


#: The same views for Spark, where only what is asked of a text goes through a join.
NARROW = {
    "fix_shift": r"""
SELECT concat('b', a.source_id, '-', a.idx) AS id, a.source_id, a.id AS left_id, b.id AS right_id, CASE WHEN a.idx % 4 = 0 THEN 'push' ELSE 'pull' END AS direction, CASE WHEN a.idx % 4 = 0 THEN a.last_word ELSE b.first_word END AS moved
FROM (SELECT id, source_id, idx, regexp_extract(text, '([^ ]+) *$', 1) AS last_word, text LIKE '%_ _%' AS two FROM fix_segment WHERE idx % 2 = 0) a
JOIN (SELECT id, source_id, idx, regexp_extract(text, '^ *([^ ]+)', 1) AS first_word, text LIKE '%_ _%' AS two FROM fix_segment WHERE idx % 2 = 1) b ON b.source_id = a.source_id AND b.idx = a.idx + 1 WHERE CASE WHEN a.idx % 4 = 0 THEN a.two ELSE b.two END""",
    "fix_overlay": VIEWS["fix_overlay"].replace("JOIN fix_segment s", "JOIN (SELECT id, left(text, 13) AS text, start_time FROM fix_segment WHERE length(text) > 20) s").replace(" AND length(s.text) > 20", ""),
}
#: Row by row what a table has; to write them would write its texts once more.
PLAIN = ("fix_variant", "fix_spine")
#: Views that are written as tables once for each session and data folder.
_TABLES: dict[tuple[str, str, str], DataFrame] = {}
#: Those that other views read as tables and never work out anew.
BASE = ("fix_segment", "fix_correction")


def _line_starts(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else list(itertools.accumulate((len(x) + 1 for x in t.split("\n")[:-1]), initial=0)))


class Views:
    """The derived tables of one data folder as DataFrames in the engine's own shape. A workspace has them as Parquet, so each is written once and read as a table."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        on_path(spark)

    def sql(self, query: str, name: str = "") -> DataFrame:
        known = re.findall(r"\bfix_\w+", with_views("spark", query))
        more = NARROW | {b: f"SELECT * FROM {self._named(b)}" for b in BASE if b in known and b != name}
        text = with_views("spark", query, more=more)
        names = [t for t in ("documents", "events", "labels", "part") if re.search(rf"\b{t}\b", text)]
        tables = ",\n".join(f"{t} AS (SELECT * FROM parquet.`{self.sf_dir}/{t}.parquet`)" for t in names)
        return self.spark.sql(with_views("spark", query, tables, more))

    def _named(self, name: str) -> str:
        """A view's table under a name for SQL."""
        table = self.view(name)
        if not hasattr(table, "_name"):
            table._name = f"kept_{uuid.uuid4().hex}"
            table.createOrReplaceTempView(table._name)
        return table._name

    def view(self, name: str) -> DataFrame:
        if name in PLAIN:
            return self.sql(f"SELECT * FROM {name}", name)
        return self._kept(name, lambda: self._lines() if name == "fix_segment" else self.sql(f"SELECT * FROM {name}", name))

    def _kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _TABLES:
            _TABLES[key] = cut(build())
        return _TABLES[key]

    def _lines(self) -> DataFrame:
        """fix_segment, where a line starts being told with the split of its text: the sum over the lines before it would deal all texts by source."""
        docs = self.spark.read.parquet(f"{self.sf_dir}/documents.parquet")
        starts = F.pandas_udf(_line_starts, "array<bigint>")("text")
        lines = docs.select(F.col("doc_id").alias("source_id"), F.posexplode(F.arrays_zip(F.split("text", "\n").alias("line"), starts.alias("cs"))).alias("idx", "l"))
        lines = lines.select("source_id", "idx", "l.line", "l.cs")
        return lines.selectExpr("concat('s', source_id, '-', idx) AS id", "source_id", "idx", "CASE WHEN idx % 7 = 3 THEN '' ELSE line END AS text", "cs / 16e0 AS start_time", "(cs + length(line)) / 16e0 AS end_time")

    @property
    def segments(self) -> DataFrame:
        return self.view("fix_segment")

    @property
    def spines(self) -> DataFrame:
        return self.view("fix_spine")

    @property
    def superseded(self) -> DataFrame:
        return self.view("fix_supersedes").select("target_id").distinct()

    @property
    def dropped(self) -> DataFrame:
        """Targets of SUPERSEDES edges, with those of speech overlays."""
        return self.view("fix_dropped").distinct()

    @property
    def sessions(self) -> DataFrame:
        return self.view("fix_session").select(F.col("session_id").alias("id"), "purpose")

    @property
    def gates(self) -> DataFrame:
        return self.view("fix_gate").withColumns({"skeleton_hash": F.lit(None).cast("string"), "seq": F.col("created_at").cast("long")})

    @property
    def corrections(self) -> DataFrame:
        """fix_op in the shape of the correction table."""
        o = self.view("fix_op")
        moved = F.when(F.col("operation") == "time_nudge", F.array(F.struct("segment_id", "edge", F.lit(None).cast("double").alias("old_time"), "new_time")))
        on = F.struct(F.lit("segment").alias("kind"), "segment_id", *[F.lit(None).cast(t).alias(n) for n, t in (("boundary_after", "string"), ("right_segment_id", "string"), ("char_start", "int"), ("char_end", "int"), ("text_snapshot", "string"))])
        return wide(
            o,
            segment_id=F.when(F.col("operation") == "replace_text", F.col("segment_id")),
            new_text=F.col("new_text"),
            edits=moved,
            after_segment_id=F.col("after_id"),
            before_segment_id=F.col("before_id"),
            start_time=F.col("ins_start"),
            end_time=F.col("ins_end"),
            text=F.col("body"),
            label=F.col("label"),
            rank=F.nullif(F.col("rank"), F.lit(0.0)),
            mark_class=F.col("mark_class"),
            anchor=F.when(F.col("operation") == "mark", on),
            entity_id=F.col("entity_id"),
            verdict=F.when(F.col("operation") == "speaker_assign", "name"),
            segment_ids=F.when(F.col("operation") == "speaker_assign", F.array("segment_id")),
        )

    @property
    def prunes(self) -> DataFrame:
        rows = self.view("fix_pruned").groupBy("id", "source_id").agg(F.array_sort(F.collect_list("segment_id")).alias("ids"))
        rows = rows.withColumns({"seq": F.lit(1).cast("long"), "created_at": F.lit(1.0), "session_id": F.lit("u0"), "correction_type": F.lit("grouping"), "operation": F.lit("prune_empty"), "status": F.lit("applied"), "rationale": F.lit(None).cast("string")})
        return wide(rows, pruned_segment_ids=F.col("ids"), pruned_count=F.size("ids"))

    @property
    def overlays(self) -> DataFrame:
        rows = self.view("fix_overlay").withColumns({"correction_type": F.lit("annotation"), "operation": F.lit("speech_overlay"), "status": F.lit("applied"), "rationale": F.lit(None).cast("string")})
        anchor = F.struct(F.lit("span").alias("kind"), "segment_id", F.lit(None).cast("string").alias("boundary_after"), F.lit(None).cast("string").alias("right_segment_id"), F.col("char_start").cast("int").alias("char_start"), F.col("char_end").cast("int").alias("char_end"), F.col("snapshot").alias("text_snapshot"))
        return wide(rows, anchor=anchor, label=F.col("label"), text=F.col("snapshot"), start_time=F.col("start_time"), end_time=F.col("end_time"), snap=F.lit("estimated"))

    @property
    def shifts(self) -> DataFrame:
        rows = self.view("fix_shift").withColumns({"seq": F.lit(0).cast("long"), "created_at": F.lit(0.0), "session_id": F.lit("u0"), "correction_type": F.lit("grouping"), "operation": F.lit("shift_boundary"), "status": F.lit("applied"), "rationale": F.lit(None).cast("string")})
        return wide(rows, boundary_after=F.col("left_id"), right_segment_id=F.col("right_id"), text=F.col("moved"), direction=F.col("direction"))

    @property
    def all_corrections(self) -> DataFrame:
        return self.corrections.unionByName(self.prunes).unionByName(self.overlays)

    @property
    def edits(self) -> DataFrame:
        """The active corrections that the effective spine stands on, written once."""
        from palimpsest.operators.projection import active_edits

        return self._kept("edits", lambda: active_edits(self.corrections.unionByName(self.prunes), self.superseded))

    @property
    def placed(self) -> DataFrame:
        """The effective spine without the texts of segments, written once: what asks for places, times and inserts only never meets the texts."""
        from palimpsest.operators.projection import place

        return self._kept("placed", lambda: place(self.segments, self.edits))

    @property
    def effective(self) -> DataFrame:
        """The effective spine, written once: what stands on it in one run of a workspace shares it."""
        return self._kept("effective", self.projected)

    def projected(self) -> DataFrame:
        from palimpsest.operators.projection import with_texts

        return with_texts(self.placed, self.segments, self.edits)


def wide(rows: DataFrame, **payload: Column) -> DataFrame:
    """Flat rows as corrections; payload fields that aren't given are null."""
    made = F.struct(*[(payload[k] if k in payload else F.lit(None)).cast(t).alias(k) for k, t in PAYLOAD_FIELDS.items()])
    none = F.lit(None).cast("string")
    return rows.select("id", "source_id", "correction_type", "operation", "status", "session_id", F.lit("human").alias("actor"), none.alias("canonical_form"), "rationale", F.col("created_at").cast("double").alias("created_at"), F.col("seq").cast("long").alias("seq"), made.alias("payload"))
