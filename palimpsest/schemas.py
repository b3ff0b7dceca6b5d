"""Row types of the tables: immutable segments, the append-only overlay, and what both are built from."""

from __future__ import annotations

from pyspark.sql import types as T

SLICE = "struct<transcript: string, start: int, end: int, content_hash: string>"
ANCHOR = "struct<kind: string, segment_id: string, boundary_after: string, right_segment_id: string, char_start: int, char_end: int, text_snapshot: string>"
EDIT = "struct<segment_id: string, edge: string, old_time: double, new_time: double>"
WORD = "struct<s: double, e: double, text: string>"

#: One wide nullable struct for all kinds of corrections, so that codegen and column pruning hold inside a payload.
PAYLOAD_FIELDS = {
    "pruned_segment_ids": "array<string>",
    "pruned_count": "int",
    "boundary_after": "string",
    "right_segment_id": "string",
    "text": "string",
    "direction": "string",
    "segment_id": "string",
    "new_text": "string",
    "old_text": "string",
    "rejected_id": "string",
    "rejected_group": "array<string>",
    "anchor": ANCHOR,
    "mark_class": "string",
    "edits": f"array<{EDIT}>",
    "boundary_words": "struct<left: string, right: string>",
    "step_s": "double",
    "after_segment_id": "string",
    "before_segment_id": "string",
    "start_time": "double",
    "end_time": "double",
    "label": "string",
    "rank": "double",
    "segment_ids": "array<string>",
    "entity_id": "string",
    "verdict": "string",
    "proposal": "map<string, string>",
    "words": f"array<{WORD}>",
    "snap": "string",
}
PAYLOAD = "struct<" + ", ".join(f"{k}: {v}" for k, v in PAYLOAD_FIELDS.items()) + ">"

TABLES = {
    "source": "id string, title string, path string, content_hash string",
    "audio_segment": "id string, source_id string, idx int, start double, end double",
    "audio_rendition": "id string, audio_segment_id string, chain array<string>, is_raw boolean, preprocessing string, model_input_path string",
    "transcript": "id string, rendition_id string, text string, transcriber string",
    "segment": f"id string, source_id string, rendition_id string, skeleton_hash string, split_policy string, idx int, text string, start_time double, end_time double, text_from string, content_hash string, source_locator string, text_slices array<{SLICE}>",
    "correction": f"id string, source_id string, correction_type string, operation string, status string, session_id string, actor string, canonical_form string, rationale string, created_at double, seq long, payload {PAYLOAD}",
    "edge": "id string, source_id string, target_id string, relation_type string, decision string, ts double, seq long",
    "session": "id string, status string, purpose string, scope array<string>, started_at double, updated_at double, seq long",
    "entity": "id string, canonical_name string, kind string, provisional boolean, variants array<string>, actor string, created_at double, updated_at double, seq long",
    "gate": "id string, source_id string, skeleton_hash string, extraction_status string, annotated_through double, session_id string, actor string, created_at double, seq long",
    "fa_cache": "text_hash string, items string, created_at double",
    "turn": "source_id string, turn_start double, turn_end double, speaker string",
    "proposal": "source_id string, proposal_id string, label string, start_time double, end_time double, score double, tier int",
    "run_event": "id string, event_type string, run_id string, actor string, payload string, at double, seq long",
    "journal": "verb string, actor string, `set` string, args string, wires string, id string, anchor string",
}

# fixed values
RUN_EVENTS = ("run_started", "run_finished")
RELATIONS = ("CORRECTS", "SUPERSEDES", "DERIVED_FROM", "ASSIGNS", "REVIEWED", "GATES")
STATUSES = ("proposed", "applied", "superseded")
SESSION_STATUSES = ("in_progress", "completed", "reopened")
EXTRACTION_STATUSES = ("in_progress", "signed_off", "excluded")
SPEAKER_VERDICTS = ("accept", "split", "name", "cluster-merge")
DIRECTIONS = ("push", "pull")
EDGES = ("start", "end")
SPLIT, SPLIT_PREFIX = "chunk-split", "chunk-split:"
GENUINE = "genuine"
LEGACY = "legacy"


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])
