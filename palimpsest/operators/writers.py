"""Building corrections: each function checks its arguments and returns a Batch of rows to append. Nothing is ever changed in place.

Rows are plain dicts in the shape of schemas.TABLES; sources.store.OverlayStore appends a batch idempotently and journals it.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from dataclasses import dataclass, field
from typing import Any

from palimpsest.schemas import DIRECTIONS, EDGES, EXTRACTION_STATUSES, GENUINE, SESSION_STATUSES, SPEAKER_VERDICTS, SPLIT, SPLIT_PREFIX

Row = dict[str, Any]


@dataclass
class Batch:
    """Rows by table, and how the change log names what was done."""

    verb: str
    session_id: str | None
    actor: str = "human"
    rows: dict[str, list[Row]] = field(default_factory=dict)
    args: Row = field(default_factory=dict)

    def add(self, table: str, *rows: Row) -> Batch:
        self.rows.setdefault(table, []).extend(rows)
        return self

    @property
    def id(self) -> str:
        """Of the first correction."""
        return self.rows["correction"][0]["id"]

    @property
    def ids(self) -> list[str]:
        return [r["id"] for r in self.rows.get("correction", [])]


def edge(source_id: str, target_id: str, relation: str, **properties: Any) -> Row:
    """Structural edges have an id made from what they connect, review markers an own one."""
    id_ = uuid.uuid4().hex if relation == "REVIEWED" else hashlib.sha256(f"{source_id}|{target_id}|{relation}".encode()).hexdigest()[:32]
    return {"id": id_, "source_id": source_id, "target_id": target_id, "relation_type": relation, "seq": time.time_ns(), **properties}


def correction(source_id: str, correction_type: str, operation: str, session_id: str, payload: Row, actor: str = "human", status: str = "applied", canonical_form: str | None = None, rationale: str | None = None) -> Row:
    """One correction row; payload fields without a value are left null."""
    return {
        "id": str(uuid.uuid4()), "source_id": source_id, "correction_type": correction_type, "operation": operation, "status": status, "session_id": session_id, "actor": actor,
        "canonical_form": canonical_form, "rationale": rationale, "created_at": time.time(), "seq": time.time_ns(), "payload": {k: v for k, v in payload.items() if v is not None},
    }


def _batch(verb: str, row: Row, corrects: list[str] = (), derived: list[str] = (), supersedes: list[str | None] = (), assigns: list[str] = ()) -> Batch:
    edges = [edge(row["id"], t, r) for r, targets in (("CORRECTS", corrects), ("DERIVED_FROM", derived), ("SUPERSEDES", supersedes), ("ASSIGNS", assigns)) for t in targets if t]
    return Batch(verb, row["session_id"], row["actor"]).add("correction", row).add("edge", *edges)


def _need(good: bool, what: str) -> None:
    if not good:
        raise ValueError(what)


def _class_name(name: str, what: str) -> str:
    name = (name or "").strip()
    _need(bool(name) and name[0].isalnum(), f"{what} must start with a letter or digit")
    return name


def reviewed(session_id: str, decisions: dict[str, str]) -> Batch:
    """REVIEWED events of a session; as events, not state: the latest of a segment counts."""
    return Batch("review-markers", session_id, args={"decisions": dict(decisions)}).add("edge", *[edge(session_id, s, "REVIEWED", decision=d, ts=time.time()) for s, d in decisions.items()])


def _with_markers(batch: Batch, decisions: dict[str, str]) -> Batch:
    return batch.add("edge", *reviewed(batch.session_id or "", decisions).rows["edge"])


def prune(source_id: str, segment_ids: list[str], session_id: str, actor: str = "human") -> Batch:
    row = correction(source_id, "grouping", "prune_empty", session_id, {"pruned_segment_ids": list(segment_ids), "pruned_count": len(segment_ids)}, actor)
    return _with_markers(_batch("prune", row, derived=list(segment_ids)), dict.fromkeys(segment_ids, "corrected"))


def amend_prune(prior: Row, rescued: list[str], session_id: str, actor: str = "human", rationale: str | None = None) -> Batch:
    """The prior prune without the rescued ids; it supersedes the prior one."""
    left = [x for x in prior["payload"]["pruned_segment_ids"] if x not in set(rescued)]
    row = correction(prior["source_id"], "grouping", "prune_empty", session_id, {"pruned_segment_ids": left, "pruned_count": len(left)}, actor, rationale=rationale)
    return _batch("prune-amendment", row, derived=left, supersedes=[prior["id"]])


def replace_text(source_id: str, segment_id: str, new_text: str, session_id: str, old_text: str | None = None, supersedes_id: str | None = None, actor: str = "human", canonical_form: str | None = None, rationale: str | None = None) -> Batch:
    row = correction(source_id, "text_content", "replace_text", session_id, {"segment_id": segment_id, "new_text": new_text, "old_text": old_text}, actor, canonical_form=canonical_form, rationale=rationale)
    return _with_markers(_batch("text-correction", row, corrects=[segment_id], supersedes=[supersedes_id]), {segment_id: "corrected"})


def shift_boundary(source_id: str, left_id: str, right_id: str, text: str, direction: str, session_id: str, supersedes_id: str | None = None, actor: str = "human", rationale: str | None = None) -> Batch:
    _need(direction in DIRECTIONS, f"direction must be among {DIRECTIONS}")
    row = correction(source_id, "grouping", "shift_boundary", session_id, {"boundary_after": left_id, "right_segment_id": right_id, "text": text, "direction": direction}, actor, rationale=rationale)
    return _with_markers(_batch("boundary-shift", row, corrects=[left_id, right_id], supersedes=[supersedes_id]), dict.fromkeys((left_id, right_id), "corrected"))


def reject(source_id: str, rejected_id: str, session_id: str, group: list[str] | None = None, actor: str = "human", rationale: str | None = None, verb: str = "reject") -> Batch:
    """A review row that supersedes a correction, with its group. Proposals, marks, inserts, splits and overlays are all taken back this way."""
    row = correction(source_id, "review", "reject", session_id, {"rejected_id": rejected_id, "rejected_group": list(group) if group else None}, actor, rationale=rationale)
    return _batch(verb, row, supersedes=[rejected_id, *(group or [])])


def dismiss_mark(source_id: str, mark_id: str, session_id: str, actor: str = "human", note: str | None = None) -> Batch:
    return reject(source_id, mark_id, session_id, None, actor, note, "mark-dismiss")


def remove_insert(source_id: str, insert_id: str, session_id: str, actor: str = "human", note: str | None = None) -> Batch:
    return reject(source_id, insert_id, session_id, None, actor, note, "chunk-insert-remove")


def remove_split(source_id: str, insert_id: str, group: list[str], session_id: str, actor: str = "human", note: str | None = None) -> Batch:
    return reject(source_id, insert_id, session_id, group, actor, note, "chunk-split-remove")


def remove_overlay(source_id: str, overlay_id: str, session_id: str, actor: str = "human", note: str | None = None) -> Batch:
    return reject(source_id, overlay_id, session_id, None, actor, note, "speech-overlay-remove")


def anchor_segments(anchor: Row) -> list[str]:
    """The segments an anchor touches: of kind segment, boundary or span (with character offsets and a snapshot)."""
    needed = {"segment": ["segment_id"], "boundary": ["boundary_after", "right_segment_id"], "span": ["segment_id"]}.get(anchor.get("kind") or "")
    _need(needed is not None, "an anchor is of kind segment, boundary or span")
    required = [*needed, *(("char_start", "char_end", "text_snapshot") if anchor["kind"] == "span" else ())]
    _need(all(anchor.get(k) is not None and anchor.get(k) != "" for k in required), f"an anchor of kind {anchor['kind']} needs {required}")
    return [anchor[k] for k in needed]


def mark(source_id: str, anchor: Row, mark_class: str, session_id: str, supersedes_id: str | None = None, actor: str = "human", note: str | None = None) -> Batch:
    name, touched = _class_name(mark_class, "a mark's class"), anchor_segments(anchor)
    row = correction(source_id, "mark", "mark", session_id, {"anchor": dict(anchor), "mark_class": name}, actor, rationale=note)
    return _batch("mark", row, corrects=touched, supersedes=[supersedes_id])


def nudge_times(source_id: str, edits: list[Row], session_id: str, boundary_words: Row | None = None, step_s: float | None = None, actor: str = "human", rationale: str | None = None) -> Batch:
    _need(1 <= len(edits) <= 2, "a nudge has one or two edits")
    _need(all(e.get("edge") in EDGES and e.get("segment_id") and e.get("new_time") is not None for e in edits), "an edit needs a segment, an edge (start or end) and a new time")
    row = correction(source_id, "timing", "time_nudge", session_id, {"edits": [dict(e) for e in edits], "boundary_words": boundary_words, "step_s": step_s}, actor, rationale=rationale)
    return _batch("time-nudge", row, corrects=[e["segment_id"] for e in edits])


def insert_chunk(source_id: str, after_id: str, start_time: float, end_time: float, session_id: str, before_id: str | None = None, label: str | None = None, text: str = "", rank: float = 0.0, actor: str = "human", rationale: str | None = None) -> Batch:
    _need(bool(after_id), "an insert needs the segment that it follows")
    _need(end_time >= start_time, "an insert can't end before it starts")
    payload = {"after_segment_id": after_id, "before_segment_id": before_id, "start_time": float(start_time), "end_time": float(end_time), "text": text, "label": label or None, "rank": rank or None}
    return _batch("chunk-insert", correction(source_id, "insertion", "chunk_insert", session_id, payload, actor, rationale=rationale), corrects=[after_id, *([before_id] if before_id else [])])


def split_chunk(source_id: str, segment_id: str, split_time: float, left_text: str, right_text: str, end_time: float, session_id: str, after_id: str, before_id: str | None = None, old_text: str | None = None, boundary_words: Row | None = None, actor: str = "human") -> Batch:
    """One batch: the right half as an insert, the left half's text, and the end moved to the split."""
    _need(bool(left_text.strip() and right_text.strip()), "both halves of a split need words")
    _need(split_time < end_time, "a split lies before the end")
    out = insert_chunk(source_id, after_id, split_time, end_time, session_id, before_id, None, right_text, 0.0, actor, SPLIT)
    tag = SPLIT_PREFIX + out.id
    text = correction(source_id, "text_content", "replace_text", session_id, {"segment_id": segment_id, "new_text": left_text, "old_text": old_text}, actor, rationale=tag)
    times = correction(source_id, "timing", "time_nudge", session_id, {"edits": [{"segment_id": segment_id, "edge": "end", "old_time": float(end_time), "new_time": float(split_time)}], "boundary_words": boundary_words}, actor, rationale=tag)
    out.verb = "chunk-split"
    out.add("correction", text, times).add("edge", edge(text["id"], segment_id, "CORRECTS"), edge(times["id"], segment_id, "CORRECTS"))
    return _with_markers(out, {segment_id: "corrected"})


def speaker_entity(canonical_name: str, session_id: str, provisional: bool = False, kind: str = "person", actor: str = "human") -> Batch:
    name = (canonical_name or "").strip()
    _need(bool(name), "an entity needs a name")
    now = time.time()
    row = {"id": str(uuid.uuid4()), "canonical_name": name, "kind": kind, "provisional": provisional, "variants": [], "actor": actor, "created_at": now, "updated_at": now, "seq": time.time_ns()}
    return Batch("speaker-entity", session_id, actor).add("entity", row)


def rename_entity(current: Row, canonical_name: str, session_id: str, provisional: bool | None = None, actor: str = "human") -> Batch:
    """The entity's next row; the latest one of an id counts."""
    name = (canonical_name or "").strip()
    _need(bool(name), "an entity needs a name")
    row = {**current, "canonical_name": name, "updated_at": time.time(), "seq": time.time_ns(), **({} if provisional is None else {"provisional": provisional})}
    return Batch("entity-rename", session_id, actor, args={"entity_id": current["id"], "canonical_name": name, "updated_at": row["updated_at"], "provisional": provisional}).add("entity", row)


def assign_speaker(source_id: str, segment_ids: list[str], entity_id: str, session_id: str, verdict: str = "name", proposal: Row | None = None, supersedes_id: str | None = None, actor: str = "human", rationale: str | None = None) -> Batch:
    _need(verdict in SPEAKER_VERDICTS, f"verdict must be among {SPEAKER_VERDICTS}")
    _need(bool(segment_ids) and bool(entity_id), "an assignment needs segments and an entity")
    payload = {"segment_ids": list(segment_ids), "entity_id": entity_id, "verdict": verdict, "proposal": {k: str(v) for k, v in proposal.items()} if proposal else None}
    row = correction(source_id, "speaker", "speaker_assign", session_id, payload, actor, canonical_form=entity_id, rationale=rationale)
    return _batch("speaker-assign", row, corrects=list(segment_ids), assigns=[entity_id], supersedes=[supersedes_id])


def overlay_speech(source_id: str, anchor: Row, label: str, start_time: float, end_time: float, text: str, session_id: str, words: list[Row] | None = None, snap: str | None = None, supersedes_id: str | None = None, actor: str = "human", note: str | None = None) -> Batch:
    name, touched = _class_name(label, "an overlay's label"), anchor_segments(anchor)
    _need(anchor["kind"] == "span", "an overlay hangs on a span")
    _need(bool((text or "").strip()), "an overlay needs text")
    _need(end_time > start_time, "an overlay needs a duration")
    payload = {"anchor": dict(anchor), "label": name, "start_time": float(start_time), "end_time": float(end_time), "text": text, "words": list(words or []), "snap": snap or "estimated"}
    return _batch("speech-overlay", correction(source_id, "annotation", "speech_overlay", session_id, payload, actor, rationale=note), corrects=touched, supersedes=[supersedes_id])


def assert_gate(source_id: str, skeleton_hash: str | None, extraction_status: str, annotated_through: float | None, session_id: str | None = None, actor: str = "human") -> Batch:
    _need(extraction_status in EXTRACTION_STATUSES, f"status must be among {EXTRACTION_STATUSES}")
    _need(annotated_through is None or annotated_through >= 0, "a watermark can't be negative")
    row = {"id": str(uuid.uuid4()), "source_id": source_id, "skeleton_hash": skeleton_hash, "extraction_status": extraction_status, "annotated_through": annotated_through, "session_id": session_id, "actor": actor, "created_at": time.time(), "seq": time.time_ns()}
    return Batch("extraction-gate", session_id, actor).add("gate", row).add("edge", edge(row["id"], source_id, "GATES"))


def start_session(scope: list[str], purpose: str | None = None, actor: str = "human") -> Batch:
    now = time.time()
    row = {"id": str(uuid.uuid4()), "status": "in_progress", "purpose": purpose, "scope": list(scope), "started_at": now, "updated_at": now, "seq": time.time_ns()}
    return Batch("session-start", row["id"], actor, args={"session_id": row["id"], "scope": list(scope), "purpose": purpose}).add("session", row)


def session_status(current: Row, status: str) -> Batch:
    """The session's next row; the latest one of an id counts."""
    _need(status in SESSION_STATUSES, f"status must be among {SESSION_STATUSES}")
    now = time.time()
    return Batch("session-status", current["id"], args={"session_id": current["id"], "status": status, "updated_at": now}).add("session", {**current, "status": status, "updated_at": now, "seq": time.time_ns()})


def session_purpose(current: Row, purpose: str) -> Batch:
    now = time.time()
    purpose = (purpose or "").strip() or GENUINE
    return Batch("session-purpose", current["id"], args={"session_id": current["id"], "purpose": purpose, "updated_at": now}).add("session", {**current, "purpose": purpose, "updated_at": now, "seq": time.time_ns()})
