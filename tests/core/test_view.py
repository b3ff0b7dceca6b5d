"""A view after a gesture equals the view that is loaded once the gesture is committed; what it shows; how a shell is started."""

import json
import os

import pytest

from palimpsest.operators import bulk
from palimpsest.operators import writers as W
from palimpsest.plans import commands, launch
from palimpsest.plans.view import SpineView
from palimpsest.sources.store import OverlayStore, load_table

SPAN = {"kind": "span", "segment_id": "k2", "char_start": 0, "char_end": 4, "text_snapshot": "Next"}


@pytest.fixture
def root(spark, tmp_path):
    path = f"file://{tmp_path}/ws"
    commands.import_rows(spark, path, "source", [{"id": "src", "title": "A talk", "path": "/talk.wav", "content_hash": "h"}, {"id": "two", "title": "A second talk"}])
    rows = [{"id": f"k{i}", "source_id": "src", "rendition_id": "r0", "idx": i, "text": t, "start_time": float(i), "end_time": i + 0.75} for i, t in enumerate(["Hello there", "", "Next one.", "last"])]
    commands.import_rows(spark, path, "segment", rows)
    commands.import_rows(spark, path, "turn", [{"source_id": "src", "turn_start": 0.0, "turn_end": 2.5, "speaker": "A"}, {"source_id": "src", "turn_start": 2.5, "turn_end": 9.0, "speaker": "B"}])
    commands.import_rows(spark, path, "audio_segment", [{"id": "a0", "source_id": "src", "idx": 0, "start": 0.0, "end": 9.0}])
    commands.import_rows(spark, path, "audio_rendition", [{"id": "r0", "audio_segment_id": "a0", "is_raw": True, "model_input_path": "/a0.wav"}])
    return path


def shown(view):
    gate = view.gate and {k: view.gate[k] for k in ("extraction_status", "annotated_through")}
    return sorted(map(repr, view.frame.drop("source_id").collect())), view.seen_overlay_labels, view.seen_mark_classes, gate


def test_after_each_gesture_the_view_is_what_a_load_shows(spark, root):
    store = OverlayStore(spark, root)
    prune, insert = W.prune("src", ["k1"], "u"), W.insert_chunk("src", "k0", 0.8, 0.9, "u", "k1", "inhale", "", 1.0)
    split = W.split_chunk("src", "k2", 2.3, "Next", "one.", 2.75, "u", "k2", "k3", "Next one.")
    mark, voice = W.mark("src", {"kind": "boundary", "boundary_after": "k2", "right_segment_id": "k3"}, "odd", "u"), W.overlay_speech("src", SPAN, "voice", 2.0, 2.3, "Next", "u")
    second = W.insert_chunk("src", "k0", 0.8, 0.85, "u", "k1", "click", "", 0.5)
    gestures = [prune, insert, second, split, mark, voice, W.assign_speaker("src", ["k0", "k3"], "e1", "u", "accept", {"cluster": "A"}), W.assert_gate("src", None, "in_progress", 2.0), W.replace_text("src", "k3", "last words", "u", "last")]
    taken_back = [W.amend_prune(prune.rows["correction"][0], ["k1"], "u"), W.dismiss_mark("src", mark.id, "u"), W.remove_overlay("src", voice.id, "u"), W.remove_insert("src", second.id, "u"), W.remove_split("src", split.id, split.ids[1:], "u"), W.assert_gate("src", None, "signed_off", 3.0)]
    view = SpineView.load(spark, root, "src")
    for some in (gestures, taken_back):
        view = view.after(*some)
        for batch in some:
            store.commit(batch)
        now = shown(view)
        assert now == shown(SpineView.load(spark, root, "src"))
        if some is gestures:
            assert view.seen_insert_labels == ["click", "inhale"] and view.seen_mark_classes == ["odd"] and view.seen_overlay_labels == ["voice"]
            assert [r["id"] for r in view.marks_for("k3").collect()] == [mark.id] and view.marks_for("k0").count() == 0
            assert [r["id"] for r in view.overlays_for("k2").collect()] == [voice.id] and view.overlay_count == 1
            assert view.prune_for("k1").first()["id"] == prune.id and view.gate["annotated_through"] == 2.0
            assert [tuple(r) for r in view.cluster_entities.collect()] == [("A", "e1")]
            assert [r["id"] for r in view.window(0, 3).orderBy("pos").collect()] == ["k0", second.id, insert.id]
    assert view.size == 5 == len(now[0]) and view.overlay_count == 0 and view.prune_for("k1").count() == 0 and now[3]["extraction_status"] == "signed_off"
    assert any("id='k2'" in x and "text='Next one.'" in x for x in now[0])


def test_pending_proposals_follow_from_the_inserts(spark, root):
    rows = spark.createDataFrame([("src", "p1", "inhale", 0.8, 0.9, 0.5, 1), ("src", "p2", "click", 2.8, 2.9, 0.5, 1), ("src", "p3", "click", 2.8, 2.9, 0.5, 2)], "source_id string, proposal_id string, label string, start_time double, end_time double, score double, tier int")
    from dataclasses import replace

    view = replace(SpineView.load(spark, root, "src"), proposals=rows)
    pending = lambda v: sorted(r["proposal_id"] for r in v.event_proposals.collect())
    insert = W.insert_chunk("src", "k0", 0.8, 0.9, "u", "k1", "inhale")
    assert pending(view) == ["p1", "p2"] and pending(view.with_tier2()) == ["p1", "p2", "p3"]
    assert pending(view.after(insert)) == ["p2"] and pending(view.after(insert, W.remove_insert("src", insert.id, "u"))) == ["p1", "p2"]
    assert {r["speaker"] for r in view.turn_proposals("k0").collect()} == {"A"} and {r["wav_path"] for r in view.chunks.collect()} == {"/a0.wav"}


def test_open_takes_exactly_one_source(spark, root):
    assert SpineView.open(spark, root, "src").title == "A talk"
    for name in ("talk", "nothing"):
        with pytest.raises(ValueError):
            SpineView.open(spark, root, name)


def test_runs_leave_events(spark, root):
    commands.run(spark, root, "src", prune=True, manifest_to=f"{root}/run.json")
    events = {r["event_type"]: r for r in load_table(spark, root, "run_event").collect()}
    assert set(events) == {"run_started", "run_finished"} and json.loads(events["run_finished"]["payload"])["status"] == "completed"
    told = json.loads(spark.read.text(f"{root}/run.json", wholetext=True).first()[0])
    assert told["run_id"] == events["run_started"]["run_id"] and told["application_id"] == spark.sparkContext.applicationId
    with pytest.raises(ValueError):
        commands.journal_run_event(OverlayStore(spark, root), "run_paused", "r", "human", {})


def test_launch_settings(tmp_path, monkeypatch):
    args = launch.build_parser().parse_args(["--test", "--audio-device", "3", "--nudge-step-ms", "20", "--shift-floor-ms", "5", "--lane", "assign"])
    monkeypatch.delenv(launch.WORKSPACE, raising=False)
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / launch.MARK).write_text("{}")
    monkeypatch.chdir(tmp_path / "a" / "b")
    got = launch.resolve_settings(args)
    assert (got["purpose"], got["audio_device"], got["nudge_step_s"], got["shift_floor_s"], got["lane"], os.path.realpath(got["workspace"])) == ("feature-test", 3, 0.02, 0.005, "assign", os.path.realpath(tmp_path / "a"))
    monkeypatch.setenv(launch.WORKSPACE, "s3a://bucket/ws")
    assert launch.find_workspace() == "s3a://bucket/ws" and launch.find_workspace("/x") == "/x"
    assert launch.resolve_settings(launch.build_parser().parse_args([]))["purpose"] is None


def test_bulk_writers_make_the_rows_that_single_ones_make(spark):
    """Payloads and edges of one decision, and what is refused."""
    stamp = {"source_id": "s", "session_id": "u", "created_at": 1.0, "seq": 1}
    d = spark.createDataFrame([{**stamp, "id": "i1", "after_id": "a", "before_id": "b", "start_time": 1.0, "end_time": 2.0, "text": None, "label": "inhale", "rank": 0.5}, {**stamp, "id": "i2", "after_id": "", "before_id": None, "start_time": 1.0, "end_time": 2.0, "text": "x", "label": "", "rank": 0.0}, {**stamp, "id": "i3", "after_id": "a", "before_id": None, "start_time": 3.0, "end_time": 2.0, "text": "x", "label": "", "rank": 0.0}], "id string, source_id string, session_id string, created_at double, seq long, after_id string, before_id string, start_time double, end_time double, text string, label string, rank double")
    made, one = bulk.chunk_inserts(d), W.insert_chunk("s", "a", 1.0, 2.0, "u", "b", "inhale", "", 0.5)
    row = made.corrections.first().asDict(recursive=True)
    given = {k: v for k, v in row["payload"].items() if v is not None}
    assert given == {k: v for k, v in one.rows["correction"][0]["payload"].items() if v is not None} and row["operation"] == "chunk_insert"
    assert sorted((e["relation_type"], e["target_id"]) for e in made.edges.collect()) == sorted((e["relation_type"], e["target_id"]) for e in one.rows["edge"])
    assert sorted(r["id"] for r in made.refused.collect()) == ["i2", "i3"]


def test_a_long_island_is_matched_as_pair_by_pair(spark):
    """The sweep gives what the greedy rule over all pairs gives."""
    import random

    from palimpsest.operators import verdicts

    rng = random.Random(3)
    p = [(f"p{n}", "src", rng.choice("ab"), t := n * 0.4 + rng.random(), t + 0.25, rng.choice([1, 1, 2])) for n in range(60)]
    h = [(f"h{n:02d}", "src", rng.choice("ab"), t := n * 0.5 + rng.random(), t + 0.25) for n in range(50)]
    free, want = {x[0]: x for x in h}, []
    mid = lambda x: (x[3] + x[4]) / 2
    for tier in (1, 2):
        open_ = {x[0]: x for x in p if x[5] == tier}
        for same in (True, False):
            for _, a, b in sorted((abs(mid(x) - mid(y)), x[0], y[0]) for x in open_.values() for y in free.values() if abs(mid(x) - mid(y)) < verdicts.RADIUS and (not same or x[2] == y[2])):
                if a in open_ and b in free:
                    want.append((a, b))
                    del open_[a], free[b]
    got = verdicts.match(spark.createDataFrame(p, "proposal_id string, source_id string, label string, start_time double, end_time double, tier int"), spark.createDataFrame(h, "insert_id string, source_id string, label string, start_time double, end_time double"))
    assert sorted((r["proposal_id"], r["insert_id"]) for r in got.collect()) == sorted(want)
