"""Writers, the append-only store, replay and the commands, end to end in a folder."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import overlay, projection
from palimpsest.operators import writers as W
from palimpsest.plans import cli, commands
from palimpsest.sources import readers
from palimpsest.sources.store import OverlayStore, load_table, load_tables, rows_of
from palimpsest.streaming import journal


@pytest.fixture
def root(spark, tmp_path):
    path = f"file://{tmp_path}/ws"
    commands.import_rows(spark, path, "source", [{"id": "src", "title": "A talk", "path": "/talk.wav", "content_hash": "h"}])
    rows = [{"id": f"k{i}", "source_id": "src", "idx": i, "text": t, "start_time": float(i), "end_time": i + 0.75} for i, t in enumerate(["Hello there", "", "Next one.", "last"])]
    commands.import_rows(spark, path, "segment", rows)
    return path


@pytest.mark.parametrize(
    "make",
    [
        lambda: W.shift_boundary("s", "a", "b", "x", "sideways", "u"),
        lambda: W.mark("s", {"kind": "span", "segment_id": "a"}, "odd", "u"),
        lambda: W.mark("s", {"kind": "page"}, "odd", "u"),
        lambda: W.mark("s", {"kind": "segment", "segment_id": "a"}, " -odd", "u"),
        lambda: W.nudge_times("s", [], "u"),
        lambda: W.insert_chunk("s", "", 0, 1, "u"),
        lambda: W.insert_chunk("s", "a", 1, 0, "u"),
        lambda: W.split_chunk("s", "a", 1.0, "x", " ", 2.0, "u", "a"),
        lambda: W.split_chunk("s", "a", 2.0, "x", "y", 2.0, "u", "a"),
        lambda: W.speaker_entity("  ", "u"),
        lambda: W.assign_speaker("s", ["a"], "e", "u", "guess"),
        lambda: W.assign_speaker("s", [], "e", "u"),
        lambda: W.overlay_speech("s", {"kind": "segment", "segment_id": "a"}, "voice", 0, 1, "x", "u"),
        lambda: W.overlay_speech("s", {"kind": "span", "segment_id": "a", "char_start": 0, "char_end": 1, "text_snapshot": "x"}, "voice", 1, 1, "x", "u"),
        lambda: W.assert_gate("s", None, "done", 1.0),
        lambda: W.assert_gate("s", None, "excluded", -1.0),
        lambda: W.session_status({"id": "u"}, "paused"),
    ],
)
def test_builders_refuse_bad_arguments(make):
    with pytest.raises(ValueError):
        make()


def test_builders_connect_what_they_touch():
    b = W.shift_boundary("s", "a", "b", "x", "push", "u", supersedes_id="old")
    assert [(e["relation_type"], e["target_id"]) for e in b.rows["edge"]] == [("CORRECTS", "a"), ("CORRECTS", "b"), ("SUPERSEDES", "old"), ("REVIEWED", "a"), ("REVIEWED", "b")]
    split = W.split_chunk("s", "a", 1.0, "x", "y", 2.0, "u", "a", "b")
    assert [c["rationale"] for c in split.rows["correction"]] == ["chunk-split", f"chunk-split:{split.id}", f"chunk-split:{split.id}"]
    assert W.assign_speaker("s", ["a"], "e", "u").rows["correction"][0]["canonical_form"] == "e"


def test_appends_are_idempotent_and_a_replay_rebuilds_the_tables(spark, root, tmp_path):
    store = OverlayStore(spark, root)
    session = store.commit(W.start_session(["src"], "")).rows["session"][0]
    text = W.replace_text("src", "k0", "Hello, there", session["id"])
    for b in (text, text, W.mark("src", {"kind": "segment", "segment_id": "k2"}, "odd", session["id"]), W.assert_gate("src", None, "signed_off", 3.0, session["id"]), W.session_purpose(session, "drill")):
        store.commit(b)
    assert store.table("correction").count() == 2
    lines = readers.journal_lines(spark, f"{root}/journal")
    again = journal.replay(lines)
    for name in ("correction", "edge", "gate"):
        assert {r["id"] for r in again[name].collect()} == {r["id"] for r in load_table(spark, root, name).collect()}
    assert again["session"].first()["purpose"] == "drill"
    assert again["correction"].where("operation = 'replace_text'").first()["payload"]["new_text"] == "Hello, there"
    activity = journal.activity(lines).where(F.col("session_id") == session["id"]).first()
    assert activity["ops"] == 6
    other = f"file://{tmp_path}/copy"
    for _ in range(2):
        journal.replay_stream(spark, f"{root}/journal", other, f"file://{tmp_path}/cp").awaitTermination()
        assert load_table(spark, other, "correction").count() == 2
    store.commit(W.mark("src", {"kind": "segment", "segment_id": "k3"}, "odd", session["id"]))
    journal.replay_stream(spark, f"{root}/journal", other, f"file://{tmp_path}/cp").awaitTermination()
    assert load_table(spark, other, "correction").count() == 3
    stream = journal.live_counts(journal.journal_stream(spark, f"{root}/journal"))
    q = stream.writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["verb"]: r["ops"] for r in spark.table("live").collect()} == {"text-correction": 2, "mark": 2}


def test_run_review_and_stats(spark, root):
    summary = commands.run(spark, root, prune=True, manifest_to=f"{root}/run.json").first()
    assert (summary["segments"], summary["empty_segments"], summary["pruned"], summary["effective_segments"], summary["flagged"]) == (4, 1, 1, 3, 2)
    assert readers.load_manifest(spark, f"{root}/run.json")["sources"] == 1
    session = W.start_session(["src"])
    OverlayStore(spark, root).commit(session)
    decisions = spark.createDataFrame([("k2", "edit", "Next one"), ("k0", "accept", None)], "segment_id string, decision string, new_text string")
    sid = session.rows["session"][0]["id"]
    sheet = commands.review(spark, root, sid, decisions)
    assert {r["id"] for r in sheet.collect()} == {"k1"}
    t = load_tables(spark, root)
    eff = projection.effective_spine(t["segment"], t["correction"], commands.superseded_of(t)).orderBy("pos").collect()
    assert [r["text"] for r in eff] == ["Hello there", "Next one", "last"]
    assert {r["decision"] for r in overlay.review_markers(t["edge"], sid).collect()} == {"corrected", "approved"}
    view = {r["id"]: r for r in commands.spine_view(t["segment"], t["correction"], commands.superseded_of(t)).collect()}
    assert view["k1"]["is_pruned"] and not view["k0"]["is_pruned"]


def test_extract_bench_transfer_and_export(spark, root, tmp_path, capsys):
    store = OverlayStore(spark, root)
    sid = store.commit(W.start_session(["src"])).rows["session"][0]["id"]
    inserts = [W.insert_chunk("src", "k0", 0.75, 1.0, sid, "k1", "inhale"), W.insert_chunk("src", "k2", 2.75, 3.0, sid, "k3", "click"), W.insert_chunk("src", "k2", 2.75, 2.8, sid, "k3")]
    for b in inserts:
        store.commit(b)
    commands.assert_gate(spark, root, "src", "in_progress", 2.0)
    assert commands.assert_gate(spark, root, "src", "signed_off")["annotated_through"] == 2.0
    made = commands.extract(spark, root, f"file://{tmp_path}/set")
    assert made["class_vocabulary"] == {"inhale": 1} and made["counts"]["skipped_above_watermark"] == 1 and made["counts"]["skipped_unlabeled"] == 1
    assert made["counts"]["speech_regions"] == 1 and made["counts"]["negative_regions"] == 1
    event = spark.read.json(f"file://{tmp_path}/set/events.jsonl").first()
    assert event["label"] == "inhale" and event["provenance"]["op_ids"] == [inserts[0].id] and event["source_title"] == "A talk"
    told = commands.export_proposals(spark, root, "src")
    assert told["counts"] == {"inhale": 1, "click": 1}
    bench = commands.bench(spark, root, "src")
    assert {r["verdict"] for r in bench.verdicts.collect()} == {"accepted"} and bench.verdicts.count() == 2 and bench.missed.count() == 0
    rows = [{"id": f"n{i}", "source_id": "src", "idx": i, "skeleton_hash": "sha256:feed", "text": "x", "start_time": i * 1.5, "end_time": i * 1.5 + 1} for i in range(3)]
    commands.import_rows(spark, root, "segment", rows)
    plan = commands.transfer_wordless(spark, root, "src", "legacy", "feed", commit=True)
    assert {r["label"]: (r["status"], r["after_id"]) for r in plan.collect()} == {"inhale": ("transfer", "n0"), "click": ("transfer", "n1")}
    assert {r["status"] for r in commands.transfer_wordless(spark, root, "src", "legacy", "feed").collect()} == {"duplicate"}
    with pytest.raises(ValueError):
        commands.transfer_wordless(spark, root, "src", "legacy", "legacy")
    assert cli.main(["stats", root, "--label", "click"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"source_id": "src", "inserts": 2, "marks": 0}
    assert cli.main(["gate", root]) == 0 and cli.main(["bench", root, "--source", "src", "--skeleton", "legacy"]) == 0


def test_proposal_sets_are_found_by_source_or_content(spark, root):
    shape = lambda n, at, **kw: {"format": readers.PROPOSAL_FORMAT, "proposal_set_id": n, "created_at": at, "source": kw, "files": {"proposals": "rows.jsonl"}}
    for n, at, kw in (("old", 1.0, {"source_id": "src"}), ("new", 2.0, {"content_hash": "h"}), ("other", 3.0, {"source_id": "else"})):
        readers.save_manifest(spark, f"{root}/proposals/{n}/manifest.json", shape(n, at, **kw))
        spark.createDataFrame([(n, "x", 0.0, 1.0, 0.0)], "proposal_id string, label string, start_time double, end_time double, score double").write.json(f"{root}/proposals/{n}/rows.jsonl")
    found = readers.find_proposal_set(spark, root, "h", "src")
    assert found[0]["proposal_set_id"] == "new"
    assert readers.find_proposal_set(spark, root, None, "src")[0]["proposal_set_id"] == "old"
    assert readers.find_proposal_set(spark, root, None, "nobody") is None and readers.find_proposal_set(spark, f"{root}/none", None, "src") is None


def test_manifests_keep_paths_of_the_workspace_relative(spark, root):
    readers.save_manifest(spark, f"{root}/m.json", {"format": "x", "path": f"{root}/a/b"}, root)
    raw = spark.read.text(f"{root}/m.json", wholetext=True).first()[0]
    assert "${WS}/a/b" in raw
    assert readers.load_manifest(spark, f"{root}/m.json", root)["path"] == f"{root}/a/b"
    assert "_warning" in readers.load_manifest(spark, f"{root}/m.json", root, "y")
    assert readers.store_path({"capabilities": {"g": {"db_path": "/x"}}}, "g") == "/x" and readers.store_path({}, "g", "/y") == "/y"


def test_audio_slices_come_from_ffmpeg(tmp_path, monkeypatch):
    tool = tmp_path / "ffmpeg"
    tool.write_text("#!/bin/sh\nfor x; do last=$x; done\necho \"$@\" > " + str(tmp_path / "args") + "\nprintf abcd\n")
    tool.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:/usr/bin:/bin")
    assert readers.audio_slice("/talk.wav", -1.0, 2.5) == b"abcd"
    args = (tmp_path / "args").read_text().split()
    assert "/talk.wav" in args and "16000" in args
    tool.write_text("#!/bin/sh\nexit 3\n")
    with pytest.raises(RuntimeError):
        readers.audio_slice("/talk.wav", 0.0, 1.0)


def test_view_state_is_merged(spark, root):
    assert readers.view_state(spark, f"{root}/view.json") == {}
    readers.save_view_state(spark, f"{root}/view.json", "src", 4, speed=1.5)
    readers.save_view_state(spark, f"{root}/view.json", "src", skeleton="legacy")
    assert readers.view_state(spark, f"{root}/view.json") == {"sources": {"src": {"cursor": 4, "skeleton": "legacy"}}, "speed": 1.5}


def test_rows_keep_every_field(spark):
    row = W.overlay_speech("s", {"kind": "span", "segment_id": "a", "char_start": 0, "char_end": 1, "text_snapshot": "x"}, "voice", 0, 1, "x", "u", [{"s": 0.0, "e": 1.0, "text": "x"}]).rows["correction"][0]
    p = rows_of(spark, "correction", [row]).first()["payload"]
    assert (p["label"], p["snap"], p["anchor"]["text_snapshot"], p["words"][0]["text"], p["new_text"]) == ("voice", "estimated", "x", "x", None)
