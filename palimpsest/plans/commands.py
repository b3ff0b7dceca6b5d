"""Composed queries over a whole workspace: what each subcommand of the command line computes, for all sources in one job."""

from __future__ import annotations

import json
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import bulk, overlay, projection, selectors, signals, spans, stats, transfer, verdicts, writers
from palimpsest.lineage import cut
from palimpsest.schemas import LEGACY, RUN_EVENTS
from palimpsest.sources import readers
from palimpsest.sources.store import OverlayStore, load_tables, rows_of


def superseded_of(tables: dict[str, DataFrame]) -> DataFrame:
    return overlay.superseded_ids(tables["edge"])


def variants_of(tables: dict[str, DataFrame]) -> DataFrame:
    return readers.variant_texts(tables["segment"], tables["transcript"])


def source_renditions(tables: dict[str, DataFrame]) -> DataFrame:
    """Renditions with the source of their audio segment."""
    audio = tables["audio_segment"].select(F.col("id").alias("audio_segment_id"), "source_id")
    return tables["audio_rendition"].join(audio, "audio_segment_id")


def one_spine(tables: dict[str, DataFrame], source: str | None, rendition: str | None = None, skeleton: str | None = None) -> DataFrame:
    """Segments of the chosen sources, renditions and skeleton; sources without renditions are taken as they are."""
    chosen = selectors.match_sources(tables["source"], source).select(F.col("id").alias("source_id"))
    rows = tables["segment"].join(chosen, "source_id", "left_semi")
    renditions = source_renditions(tables)
    return selectors.spine(rows, None if renditions.isEmpty() else renditions.join(chosen, "source_id", "left_semi"), rendition, skeleton, one=True)


def review_sheet(segments: DataFrame, corrections: DataFrame, superseded: DataFrame, variants: DataFrame | None = None, markers: DataFrame | None = None, prior: DataFrame | None = None) -> DataFrame:
    """The worklist with what a reviewer looks at: source_id, id, idx, flags, text (as corrected), variant_text, prior_text.

    `prior` has content_hash and new_text of corrections of the same audio elsewhere, and segments a content_hash.
    """
    diverging = None if variants is None else cut(signals.divergence(segments, variants).select("id", "variant_text"))
    items = signals.signal_flags(segments, diverging=diverging).where(F.size("flags") > 0)
    if markers is not None:
        items = signals.worklist(items, markers)
    current = overlay.latest_texts(corrections, superseded).select(F.col("segment_id").alias("_s"), F.col("payload.new_text").alias("_new"))
    rows = items.join(current, F.col("id") == F.col("_s"), "left").withColumn("text", F.coalesce("_new", "text")).drop("_s", "_new")
    if diverging is not None:
        rows = rows.join(diverging, "id", "left")
    else:
        rows = rows.withColumn("variant_text", F.lit(None).cast("string"))
    if prior is not None and "content_hash" in rows.columns:
        first = prior.groupBy("content_hash").agg(F.min("new_text").alias("prior_text"))
        rows = rows.join(first, "content_hash", "left")
    else:
        rows = rows.withColumn("prior_text", F.lit(None).cast("string"))
    return rows.select("source_id", "id", "idx", "flags", "text", "variant_text", "prior_text")


def prune_plan(segments: DataFrame) -> DataFrame:
    """One prune for each source that has empty segments: source_id, pruned_segment_ids (in spine order), pruned_count."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("idx", "id"))), lambda x: x["id"])
    return selectors.empty_segments(segments).groupBy("source_id").agg(ids.alias("pruned_segment_ids")).withColumn("pruned_count", F.size("pruned_segment_ids"))


def gate_table(segments: DataFrame, gates: DataFrame) -> DataFrame:
    """Spines and their latest gates, each also without the other: source_id, skeleton_hash, split_policy, segments, end_s, extraction_status, annotated_through, gone (a gate without a spine)."""
    ends = segments.groupBy("source_id", "skeleton_hash").agg(F.max("end_time").alias("end_s"))
    known = selectors.observed_spines(segments).withColumn("_k", F.coalesce("skeleton_hash", F.lit(LEGACY)))
    known = known.join(ends.withColumn("_k", F.coalesce("skeleton_hash", F.lit(LEGACY))).drop("skeleton_hash"), ["source_id", "_k"])
    latest = overlay.latest_gates(gates).select("source_id", F.coalesce("skeleton_hash", F.lit(LEGACY)).alias("_k"), "extraction_status", "annotated_through")
    both = known.join(latest, ["source_id", "_k"], "full")
    return both.select("source_id", F.when(F.col("_k") != LEGACY, F.col("_k")).alias("skeleton_hash"), "split_policy", "segments", "end_s", "extraction_status", "annotated_through", F.col("segments").isNull().alias("gone"))


def spine_view(segments: DataFrame, corrections: DataFrame, superseded: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The effective spine as an editor shows it: pruned segments stay, marked as such, and is_marked, mark_classes, has_overlay, entity_id, split_group are told for each row."""
    keys = keys or ["source_id"]
    live = projection.active_edits(corrections, superseded)
    rows = projection.place(segments, live, keys, withhold_prunes=True)
    anchor = F.col("payload.anchor")
    on = F.array_compact(F.array(anchor["segment_id"], anchor["boundary_after"], anchor["right_segment_id"]))
    marks = overlay.open_marks(corrections, superseded).select(F.explode(F.array_distinct(on)).alias("id"), F.col("payload.mark_class").alias("c"))
    marks = marks.groupBy("id").agg(F.array_sort(F.collect_set("c")).alias("mark_classes"))
    voices = overlay.speech_overlays(corrections, superseded).select(anchor["segment_id"].alias("id")).where("id IS NOT NULL").distinct().withColumn("_voice", F.lit(True))
    said = overlay.assignments(corrections, superseded).select(F.col("segment_id").alias("id"), "entity_id")
    groups = overlay.split_groups(overlay.active(corrections, superseded)).groupBy(F.col("insert_id").alias("id")).agg(F.array_sort(F.collect_list("member_id")).alias("split_group"))
    for part in (marks, voices, said, groups):
        rows = rows.join(part, "id", "left")
    rows = rows.withColumns({"is_marked": F.col("mark_classes").isNotNull(), "has_overlay": F.coalesce("_voice", F.lit(False))}).drop("_voice")
    return projection.with_texts(rows, segments, live, keys)


def proposal_rows(donors: DataFrame) -> DataFrame:
    """Donors as rows of a proposal set: times and rank to 4 places, tier 1, an id made from what they are."""
    id_ = F.sha2(F.concat_ws("|", "source_id", "insert_id"), 256).substr(1, 32)
    return donors.select("source_id", id_.alias("proposal_id"), "label", F.bround("start_time", 4).alias("start_time"), F.bround("end_time", 4).alias("end_time"), F.bround("rank", 4).alias("score"), F.lit(1).alias("tier"))


# ---- commands over a workspace


def engine_info(spark: SparkSession) -> dict[str, Any]:
    """Which engine made a result: for manifests and run events."""
    return {"spark": spark.version, "application_id": spark.sparkContext.applicationId, "master": spark.sparkContext.master, "timezone": spark.conf.get("spark.sql.session.timeZone")}


def journal_run_event(store: OverlayStore, event_type: str, run_id: str, actor: str, payload: dict[str, Any]) -> None:
    """One event of a run. Events of a run share its id, which its manifest has, too."""
    if event_type not in RUN_EVENTS:
        raise ValueError(f"{event_type!r} is not among {RUN_EVENTS}")
    row = {"id": f"{run_id}:{event_type}", "event_type": event_type, "run_id": run_id, "actor": actor, "payload": json.dumps(payload, ensure_ascii=False), "at": time.time(), "seq": time.time_ns()}
    store.append("run_event", rows_of(store.spark, "run_event", [row]))


def run(spark: SparkSession, root: str, source: str | None = None, prune: bool = False, actor: str = "human", purpose: str | None = None, manifest_to: str | None = None) -> DataFrame:
    """A correction run: a session over the chosen sources, a prune of empty segments if wanted, and the summary of each source. Run events say when it began, and how it ended."""
    store, run_id = OverlayStore(spark, root), readers.new_id("correct")
    config = {"source": source, "prune": prune, "actor": actor}
    journal_run_event(store, "run_started", run_id, actor, config)
    try:
        summary, session, sources = _run(spark, root, store, source, prune, actor, purpose)
    except BaseException as e:
        journal_run_event(store, "run_finished", run_id, actor, {"status": "failed", "error": str(e)[:500]})
        raise
    journal_run_event(store, "run_finished", run_id, actor, {"status": "completed", "session_id": session["id"]})
    if manifest_to is not None:
        record = {"format": readers.RUN_FORMAT, "version": "0.2.0", "run_id": run_id, "created_at": time.time(), "config": config, "session_id": session["id"], **engine_info(spark), "signals_used": [signals.EMPTY, signals.UNTIMED, signals.NO_TERMINAL, signals.NOT_UPPER, signals.DIVERGES], "sources": sources}
        readers.save_manifest(spark, manifest_to, record, root)
    return summary


def _run(spark: SparkSession, root: str, store: OverlayStore, source: str | None, prune: bool, actor: str, purpose: str | None) -> tuple[DataFrame, dict[str, Any], int]:
    tables = load_tables(spark, root)
    chosen = selectors.match_sources(tables["source"], source).select(F.col("id").alias("source_id"))
    segments = tables["segment"].join(chosen, "source_id", "left_semi")
    scope = [r[0] for r in chosen.orderBy("source_id").collect()]  # one id a source: a session names its scope
    session = store.commit(writers.start_session(scope, purpose, actor)).rows["session"][0]
    if prune:
        commit_prunes(spark, store, segments, session["id"], actor)
        tables = load_tables(spark, root)
    dead = superseded_of(tables)
    own = tables["correction"].join(chosen, "source_id", "left_semi")
    removed = overlay.active(own.where("operation = 'prune_empty'"), dead).select("source_id", F.explode("payload.pruned_segment_ids").alias("id"))
    flagged = signals.signal_flags(segments, readers.variant_texts(segments, tables["transcript"]))
    summary = stats.run_summary(segments, flagged, projection.effective_spine(segments, own, dead), removed)
    store.commit(writers.session_status(session, "completed"))
    return summary, session, len(scope)


def commit_prunes(spark: SparkSession, store: OverlayStore, segments: DataFrame, session_id: str, actor: str) -> None:
    """One prune correction for each source, built and appended on the executors, with its edges and review markers; one line in the change log says so."""
    now, seq = time.time(), time.time_ns()
    plan = prune_plan(segments).withColumn("id", F.sha2(F.concat_ws("|", F.lit(session_id), "source_id"), 256).substr(1, 32))
    from palimpsest.schemas import PAYLOAD_FIELDS

    given = {"pruned_segment_ids": F.col("pruned_segment_ids"), "pruned_count": F.col("pruned_count")}
    payload = F.struct(*[(given.get(k, F.lit(None))).cast(t).alias(k) for k, t in PAYLOAD_FIELDS.items()])
    fixed = {"correction_type": "grouping", "operation": "prune_empty", "status": "applied", "session_id": session_id, "actor": actor}
    rows = plan.select("id", "source_id", *[F.lit(v).alias(k) for k, v in fixed.items()], F.lit(None).cast("string").alias("canonical_form"), F.lit(None).cast("string").alias("rationale"), F.lit(now).alias("created_at"), F.lit(seq).cast("long").alias("seq"), payload.alias("payload"))
    each = plan.select("id", F.explode("pruned_segment_ids").alias("segment"))
    kinds = F.array(F.struct(F.col("id").alias("source_id"), F.lit("DERIVED_FROM").alias("relation_type"), F.lit(None).cast("string").alias("decision")), F.struct(F.lit(session_id).alias("source_id"), F.lit("REVIEWED").alias("relation_type"), F.lit("corrected").alias("decision")))
    edges = each.select("segment", F.explode(kinds).alias("e")).select(F.sha2(F.concat_ws("|", "e.source_id", "segment", "e.relation_type"), 256).substr(1, 32).alias("id"), "e.source_id", F.col("segment").alias("target_id"), "e.relation_type", "e.decision", F.when(F.col("e.decision").isNotNull(), F.lit(now)).alias("ts"), F.lit(seq).cast("long").alias("seq"))
    store.append("edge", edges)
    store.append("correction", rows)
    store.commit(writers.Batch("prune", session_id, actor, args={"created_at": now}))


def review(spark: SparkSession, root: str, session_id: str, decisions: DataFrame | None = None, max_items: int = 0) -> DataFrame:
    """The review sheet of a session; `decisions` (segment_id, decision 'accept', 'edit' or 'skip', new_text) are applied first."""
    store = OverlayStore(spark, root)
    if decisions is not None:
        apply_decisions(store, load_tables(spark, root), session_id, decisions)
    tables = load_tables(spark, root)
    markers = overlay.review_markers(tables["edge"], session_id)
    texts = overlay.prior_by_hash(tables["correction"].where("correction_type = 'text_content'"), tables["edge"], tables["segment"]).select("content_hash", F.col("payload.new_text").alias("new_text"))
    sheet = review_sheet(tables["segment"], tables["correction"], superseded_of(tables), variants_of(tables), markers, texts)
    return sheet.orderBy("source_id", "idx", "id").limit(max_items) if max_items else sheet


def apply_decisions(store: OverlayStore, tables: dict[str, DataFrame], session_id: str, decisions: DataFrame) -> None:
    """Decisions become text corrections (edit) and review markers (all), appended on the executors."""
    from palimpsest.schemas import PAYLOAD_FIELDS

    now, seq = time.time(), time.time_ns()
    known = decisions.join(tables["segment"].select(F.col("id").alias("segment_id"), "source_id", F.col("text").alias("_old")), "segment_id")
    old = overlay.latest_texts(tables["correction"], superseded_of(tables)).select("segment_id", F.col("id").alias("_prior"))
    edits = known.where("decision = 'edit' AND new_text IS NOT NULL").join(old, "segment_id", "left").withColumn("id", F.sha2(F.concat_ws("|", F.lit(session_id), "segment_id", "new_text", F.lit(str(seq))), 256).substr(1, 32))
    given = {"segment_id": F.col("segment_id"), "new_text": F.col("new_text"), "old_text": F.col("_old")}
    payload = F.struct(*[(given.get(k, F.lit(None))).cast(t).alias(k) for k, t in PAYLOAD_FIELDS.items()])
    none = F.lit(None).cast("string")
    rows = edits.select("id", "source_id", F.lit("text_content").alias("correction_type"), F.lit("replace_text").alias("operation"), F.lit("applied").alias("status"), F.lit(session_id).alias("session_id"), F.lit("human").alias("actor"), none.alias("canonical_form"), none.alias("rationale"), F.lit(now).alias("created_at"), F.lit(seq).cast("long").alias("seq"), payload.alias("payload"))
    edge = lambda a, b, kind: (a.alias("source_id"), b.alias("target_id"), F.lit(kind).alias("relation_type"))
    shape = lambda df, *ab: df.select(*edge(*ab)).where("target_id IS NOT NULL").withColumns({"decision": none, "ts": F.lit(None).cast("double")})
    edges = shape(edits, F.col("id"), F.col("segment_id"), "CORRECTS").unionByName(shape(edits, F.col("id"), F.col("_prior"), "SUPERSEDES"))
    told = F.when(F.col("decision") == "edit", "corrected").when(F.col("decision") == "accept", "approved").otherwise("skipped")
    edges = edges.unionByName(known.select(*edge(F.lit(session_id), F.col("segment_id"), "REVIEWED"), told.alias("decision"), F.lit(now).alias("ts")))
    edges = edges.withColumns({"id": F.sha2(F.concat_ws("|", "source_id", "target_id", "relation_type", F.lit(str(seq))), 256).substr(1, 32), "seq": F.lit(seq).cast("long")})
    store.append("edge", edges)
    store.append("correction", rows)


def _skeleton():
    return F.when(F.col("spine") != LEGACY, F.col("spine")).alias("skeleton_hash")


def dataset_events(got: spans.Extraction, sources: DataFrame) -> DataFrame:
    """The examples of an extraction as rows of a dataset, with their source and where they come from."""
    known = sources.select(F.col("id").alias("source_id"), F.col("title").alias("source_title"), F.col("path").alias("source_path"), F.col("content_hash").alias("source_content_hash"))
    provenance = F.struct(F.lit("real").alias("tag"), F.col("session_ids").alias("sessions"), "op_ids").alias("provenance")
    kind = F.when(F.col("kind") == "insert", "labeled_span").otherwise("speech_overlay").alias("kind")
    return got.examples.join(known, "source_id", "left").select(kind, "source_id", "source_title", "source_path", "source_content_hash", _skeleton(), F.col("event_id").alias("id"), "segment_id", "label", "text", "speech", "start_time", "end_time", F.lit("train").alias("split"), provenance)


def dataset_regions(got: spans.Extraction) -> DataFrame:
    """What is speech and what is nothing, below the watermarks."""
    rows = lambda df, kind: df.select(F.lit(kind).alias("kind"), "source_id", _skeleton(), "start_time", "end_time")
    return rows(got.speech, "speech").unionByName(rows(got.negatives, "negative"))


def extract(spark: SparkSession, root: str, out: str, source: str | None = None, purposes: list[str] | None = None, rendition: str | None = None) -> dict[str, Any]:
    """The gated dataset of all eligible spines: events and regions as JSON lines below `out`, and a manifest, which is returned."""
    tables = load_tables(spark, root)
    purposes = purposes or ["genuine"]
    chosen = selectors.match_sources(tables["source"], source).select(F.col("id").alias("source_id"))
    segments = tables["segment"].join(chosen, "source_id", "left_semi")
    renditions = source_renditions(tables)
    if not renditions.isEmpty():
        segments = selectors.spine(segments, renditions.join(chosen, "source_id", "left_semi"), rendition)
    segments = segments.withColumn("spine", projection.spine_key())
    got = spans.Extraction(segments, tables["correction"], superseded_of(tables), tables["gate"].join(chosen, "source_id", "left_semi"), overlay.sessions_for(overlay.latest_rows(tables["session"]), purposes))
    events, regions = dataset_events(got, tables["source"]), dataset_regions(got)
    events.write.mode("errorifexists").json(f"{out}/events.jsonl")
    regions.write.mode("errorifexists").json(f"{out}/regions.jsonl")
    kinds = dict(spark.read.json(f"{out}/regions.jsonl").groupBy("kind").count().collect()) if not regions.isEmpty() else {}
    vocabulary = {r["label"]: r["n"] for r in got.vocabulary.collect()}  # one row a class
    skipped = {r["skip_reason"]: r["n"] for r in got.skipped.collect()}  # one row a reason
    manifest = {
        "format": readers.DATASET_FORMAT, "version": "0.1.0", "dataset_id": readers.new_id("dataset"), "created_at": time.time(), "config": {"source": source, "rendition": rendition, "include_purposes": purposes},
        "session_purpose_policy": {"include": purposes, "unset_means": "genuine"}, "split_policy": {"policy": "tail-reservation", "train": "below each spine's watermark", "bench": "above it, never extracted"}, "augmentation_policy": {"policy": "none"},
        "class_vocabulary": vocabulary, "spines": got.gates.count(), "files": {"events": "events.jsonl", "regions": "regions.jsonl"},
        "counts": {"examples": sum(vocabulary.values()), "speech_regions": kinds.get("speech", 0), "negative_regions": kinds.get("negative", 0), **{f"skipped_{k}": v for k, v in sorted(skipped.items())}},
    }
    readers.save_manifest(spark, f"{out}/manifest.json", manifest, root)
    return manifest


def bench(spark: SparkSession, root: str, source_id: str, skeleton: str | None = None, purposes: list[str] | None = None, tolerance: float = verdicts.TOLERANCE, rows: DataFrame | None = None, window: tuple[float, float | None] = (0.0, None)) -> verdicts.Bench:
    """Verdicts on a source's newest proposal set, or on the given proposals."""
    tables = load_tables(spark, root)
    if rows is None:
        found = readers.find_proposal_set(spark, root, source_id=source_id)
        if found is None:
            raise ValueError(f"no proposal set for {source_id}")
        manifest, rows = found
        given = manifest.get("window") or {}
        window = (given.get("start") or 0.0, given.get("end"))
        skeleton = skeleton or (manifest["source"] or {}).get("skeleton_hash")
    segments = one_spine(tables, source_id, skeleton=skeleton)
    own, dead = tables["correction"].where(F.col("source_id") == source_id), superseded_of(tables)
    inserts = spans.insert_spans(projection.effective_spine(segments, own, dead), own, dead)
    if purposes is not None:
        inserts = inserts.join(overlay.sessions_for(overlay.latest_rows(tables["session"]), purposes), "session_id", "left_semi")
    return verdicts.Bench(rows.withColumn("source_id", F.lit(source_id)), inserts, window, tolerance)


def transfer_wordless(spark: SparkSession, root: str, source_id: str, from_skeleton: str, to_skeleton: str, labels: list[str] | None = None, tolerance: float = 0.15, commit: bool = False, actor: str = "human") -> DataFrame:
    """The plan that moves wordless inserts from one spine of a source to another, carried out if `commit` is set. ValueError for an empty spine or one and the same."""
    tables = load_tables(spark, root)
    from_, to = one_spine(tables, source_id, skeleton=from_skeleton), one_spine(tables, source_id, skeleton=to_skeleton)
    if from_.isEmpty() or to.isEmpty():
        raise ValueError("a spine is empty")
    if from_.join(to.select("id"), "id", "left_anti").isEmpty():
        raise ValueError("both selectors name one spine")
    own, dead = tables["correction"].where((F.col("source_id") == source_id) & (F.col("status") != "proposed")), superseded_of(tables)
    donors = transfer.wordless_donors(projection.effective_spine(from_, own, dead), labels)
    plan = transfer.transfer_plan(donors, projection.effective_spine(to, own, dead), to, tolerance)
    if commit:
        store = OverlayStore(spark, root)
        session = store.commit(writers.start_session([source_id], "wordless-transfer", actor)).rows["session"][0]
        now, seq = time.time(), time.time_ns()
        moved = plan.where("status = 'transfer'").select(F.sha2(F.concat_ws("|", F.lit(session["id"]), "insert_id"), 256).substr(1, 32).alias("id"), "source_id", F.lit(session["id"]).alias("session_id"), F.lit(now).alias("created_at"), F.lit(seq).alias("seq"), "after_id", "before_id", "start_time", "end_time", F.lit("").alias("text"), "label", "rank", F.lit(actor).alias("actor"))
        made = bulk.chunk_inserts(cut(moved))
        store.append("edge", made.edges)
        store.append("correction", made.corrections)
        store.commit(writers.Batch("chunk-insert", session["id"], actor, args={"created_at": now}))
        store.commit(writers.session_status(session, "completed"))
    return plan


def export_proposals(spark: SparkSession, root: str, source_id: str, skeleton: str | None = None, labels: list[str] | None = None) -> dict[str, Any]:
    """A source's wordless inserts as a proposal set below `root`/proposals; returns its manifest."""
    tables = load_tables(spark, root)
    own, dead = tables["correction"].where(F.col("source_id") == source_id), superseded_of(tables)
    segments = one_spine(tables, source_id, skeleton=skeleton)
    rows = proposal_rows(transfer.wordless_donors(projection.effective_spine(segments, own, dead), labels)).orderBy("start_time", "proposal_id")
    id_ = readers.new_id("proposals")
    path = f"{root}/proposals/{id_}"
    rows.drop("source_id").write.json(f"{path}/proposals.jsonl")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # one row a class
    media = tables["source"].where(F.col("id") == source_id).first()
    chosen = segments.select("skeleton_hash").first()
    manifest = {
        "format": readers.PROPOSAL_FORMAT, "version": "0.2.0", "proposal_set_id": id_, "created_at": time.time(), "config": {"from_skeleton": skeleton, "labels": sorted(labels) if labels else None}, "model": {"kind": "human-effective-layer"},
        "source": {"source_id": source_id, "path": media and media["path"], "content_hash": media and media["content_hash"], "skeleton_hash": chosen and chosen[0]},
        "window": {"start": 0.0, "end": rows.agg(F.max("end_time")).first()[0]}, "classes": sorted(counts), "files": {"proposals": "proposals.jsonl"}, "counts": counts,
    }
    readers.save_manifest(spark, f"{path}/manifest.json", manifest, root)
    return manifest


def scan_mishomed(spark: SparkSession, root: str, source: str | None = None, rendition: str | None = None, skeleton: str | None = None, min_overlap: float = 0.05) -> DataFrame:
    """Mis-homed words of the chosen sources, with mechanisms where a single source has a proposal set."""
    tables = load_tables(spark, root)
    segments = one_spine(tables, source, rendition, skeleton)
    used = tables["transcript"].join(segments.select(F.col("text_from").alias("id")).distinct(), "id", "left_semi")
    words = readers.alignment_words(used, tables["audio_rendition"], tables["audio_segment"], tables["fa_cache"]).select("source_id", "s", "e", "text")
    some = segments.select("source_id").distinct().limit(2).collect()
    found = readers.find_proposal_set(spark, root, source_id=some[0][0]) if len(some) == 1 else None
    return transfer.scan_mishomed(words, segments, found[1] if found else None, min_overlap)


def assert_gate(spark: SparkSession, root: str, source_id: str, status: str, watermark: float | str | None = None, skeleton: str | None = None, session_id: str | None = None) -> dict[str, Any]:
    """A gate on one spine. A watermark of 'end' is the end of the spine; None keeps the one that holds."""
    tables = load_tables(spark, root)
    segments = one_spine(tables, source_id, skeleton=skeleton)
    hash_ = segments.select("skeleton_hash").first()
    hash_ = hash_ and hash_[0]
    if watermark == "end":
        watermark = segments.agg(F.max("end_time")).first()[0]
    elif watermark is None:
        now = overlay.latest_gates(tables["gate"]).where((F.col("source_id") == source_id) & F.col("skeleton_hash").eqNullSafe(hash_)).first()
        watermark = now and now["annotated_through"]
    return OverlayStore(spark, root).commit(writers.assert_gate(source_id, hash_, status, None if watermark is None else float(watermark), session_id)).rows["gate"][0]


def import_rows(spark: SparkSession, root: str, name: str, rows: list[dict[str, Any]]) -> None:
    """Append dicts to a table of a workspace."""
    OverlayStore(spark, root).append(name, rows_of(spark, name, rows))


def write_json(df: DataFrame, path: str | None) -> None:
    """A result as JSON lines in a folder, or printed row by row."""
    if path:
        df.write.json(path)
        return
    for row in df.toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str))
