"""Scans, gaps, as-of joins, verdicts and worklists against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions import words as FW
from palimpsest.operators import intervals, ordering, overlay, planners, proposals, selectors, signals, transfer, verdicts
from palimpsest.operators import writers as W
from tests.core.helpers import corrections, segments, targets


def test_scans_carry_over_buckets(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), n, rng.choice([None, rng.randrange(50)])) for n in range(60)]
    df = spark.createDataFrame(rows, "k string, n int, v int")
    v = F.col("v")
    got = ordering.scan(df, ["k"], ["n"], {"count": ("count", F.lit(1)), "sum": ("sum", v), "max": ("max", v), "last": ("last", v), "next": ("next", v)}, ordering.bucket_of("n", 7)).collect()
    assert len(got) == 60
    for r in got:
        before = [x for k, n, x in rows if k == r["k"] and n < r["n"]]
        some = [x for x in before if x is not None]
        behind = [x for k, n, x in rows if k == r["k"] and n > r["n"] and x is not None]
        assert (r["count"], r["sum"], r["max"], r["last"], r["next"]) == (len(before) + 1, sum(some) if some else None, max(some, default=None), some[-1] if some else None, behind[0] if behind else None)


def test_gaps_equal_a_sweep_over_ticks(spark):
    rng = random.Random(2)
    spans = [(rng.choice("abc"), rng.randrange(-20, 200) / 4, rng.randrange(-20, 260) / 4) for _ in range(40)]
    bounds = [("a", 50.0), ("b", 20.0), ("c", 0.0), ("d", 3.0), ("e", None)]
    got = intervals.gaps(spark.createDataFrame(spans, "k string, start_time double, end_time double"), spark.createDataFrame(bounds, "k string, watermark double"), ["k"]).collect()
    for k, w in bounds:
        free = [t for t in range(int(4 * (w or 0))) if not any(s[0] == k and s[1] * 4 <= t < s[2] * 4 for s in spans)]
        told = sorted((r["start_time"], r["end_time"]) for r in got if r["k"] == k)
        assert [t for a, b in told for t in range(int(a * 4), int(b * 4))] == free
        assert all(b < c for (_, b), (c, _) in zip(told, told[1:]))  # noqa: B905


@pytest.mark.parametrize("size", [1.0, 64.0])
def test_overlap_and_as_of_joins_equal_loops(spark, size):
    rng = random.Random(3)
    a = [("k", n, (s := rng.randrange(400) / 8), s + rng.choice([0, 0.5, 3, 20])) for n in range(40)]
    b = [("k", n, (s := rng.randrange(400) / 8), s + rng.choice([0, 0.5, 3, 20])) for n in range(40)]
    left, right = spark.createDataFrame(a, "k string, i int, s double, e double"), spark.createDataFrame(b, "k string, j int, s2 double, e2 double")
    got = {(r["i"], r["j"]) for r in intervals.overlap_join(left, right, ["k"], ("s", "e"), ("s2", "e2"), size).collect()}
    assert got == {(x[1], y[1]) for x in a for y in b if x[3] > x[2] and y[3] > y[2] and y[2] < x[3] and y[3] > x[2]}
    found = ordering.as_of(left, right, ["k"], "s", "s2", ["j"], ["j"], size).collect()
    want = {x[1]: max(((y[2], y[1]) for y in b if y[2] <= x[2]), default=(None, None))[1] for x in a}
    assert {r["i"]: r["found"] and r["found"]["j"] for r in found} == want


def greedy(ps, hs):
    """Global nearest pair first: same label, then any; tier 1, then tier 2."""
    out, free = {}, sorted(hs, key=lambda h: (h[2], h[3], h[0]))
    for tier in (1, 2):
        own = sorted((p for p in ps if p[4] == tier), key=lambda p: (p[2], p[0]))
        for same in (True, False):
            pairs = sorted((abs((h[2] + h[3] - p[2] - p[3]) / 2), i, j) for i, p in enumerate(own) for j, h in enumerate(free) if abs((h[2] + h[3] - p[2] - p[3]) / 2) < 2 and (not same or h[1] == p[1]))
            for _, i, j in pairs:
                if own[i][0] not in out and free[j][0] not in out.values():
                    out[own[i][0]] = free[j][0]
    return out


def test_verdicts_equal_a_global_greedy_match(spark):
    rng = random.Random(4)
    at = lambda: (s := rng.randrange(1600) / 16, s + rng.randrange(1, 12) / 16)
    ps = [(f"p{n}", rng.choice("xy"), *at(), rng.choice([1, 1, 2])) for n in range(60)] + [("p-3", "x", 1.0, 2.0, 3)]
    hs = [(f"h{n}", rng.choice("xy"), *at()) for n in range(50)]
    proposals_ = spark.createDataFrame([("src", *p) for p in ps], "source_id string, proposal_id string, label string, start_time double, end_time double, tier int")
    inserts = spark.createDataFrame([("src", *h) for h in hs], "source_id string, insert_id string, label string, start_time double, end_time double")
    bench = verdicts.Bench(proposals_, inserts)
    got = {r["proposal_id"]: r["insert_id"] for r in bench.verdicts.collect()}
    want = greedy(ps, hs)
    assert {p: h for p, h in got.items() if h} == want and "p-3" not in got
    assert {r["insert_id"] for r in bench.missed.collect()} == {h[0] for h in hs} - set(want.values())
    counts = {(r["tier"], r["verdict"]): r["n"] for r in bench.counts.collect()}
    assert sum(counts.values()) == 60 and (2, "rejected") not in counts and (1, "unaccepted") not in counts


def test_verdict_tolerance_is_inclusive_and_radius_strict(spark):
    ps = spark.createDataFrame([("s", "near", "x", 1.0, 2.0, 1), ("s", "moved", "x", 11.0, 12.0, 1), ("s", "named", "x", 21.0, 22.0, 1), ("s", "far", "x", 31.0, 32.0, None)], "source_id string, proposal_id string, label string, start_time double, end_time double, tier int")
    hs = spark.createDataFrame([("s", "h1", "x", 1.125, 2.0), ("s", "h2", "x", 11.5, 12.5), ("s", "h3", "y", 21.0, 22.0), ("s", "h4", "x", 33.0, 34.0), ("s", "h5", None, 31.0, 32.0)], "source_id string, insert_id string, label string, start_time double, end_time double")
    got = {r["proposal_id"]: r["verdict"] for r in verdicts.Bench(ps, hs, tolerance=0.125).verdicts.collect()}
    assert got == {"near": "accepted", "moved": "edited", "named": "relabeled", "far": "rejected"}


def test_flags_and_worklist(spark):
    segs = segments(spark, ("a", "No end here", 0.0, 1.0), ("b", "Starts upper.", 1.0, None), ("c", "lower start.", 2.0, 3.0), ("d", " \x1c", 3.0, 4.0), ("e", "字 has no case", 4.0, 5.0))
    got = {r["id"]: r["flags"] for r in signals.signal_flags(segs).collect()}
    assert got == {"a": ["boundary-missing-terminal"], "b": ["missing-timing", "boundary-terminal-then-lowercase"], "c": [], "d": ["empty-text"], "e": []}
    edges = spark.createDataFrame([("REVIEWED", "s", "a", "approved", 1.0, 1), ("REVIEWED", "s", "b", "approved", 1.0, 2), ("REVIEWED", "s", "b", "unreviewed", 1.0, 3)], "relation_type string, source_id string, target_id string, decision string, ts double, seq long")
    left = signals.worklist(signals.signal_flags(segs), overlay.review_markers(edges, "s"))
    assert {r["id"] for r in left.collect()} == {"b", "d"}


@pytest.mark.parametrize(("word", "key"), [("Robert", "r163"), ("Rupert", "r163"), ("ashcraft", "a226"), ("Tymczak", "t522"), ("Pfister", "p236"), ("", ""), ("42", ""), ("é", "é000"), ("o'Neil", "o540")])
def test_phonetic_keys(spark, word, key):
    assert spark.range(1).select(T.phonetic_key(F.lit(word))).first()[0] == key


def test_spellings_cluster_around_their_first_member(spark):
    words = ["Marlowe", "marlow", "Marlo", "Harlow", "merlowe", "x" * 40, "x" * 41, " ", "Marlowe"]
    got = signals.cluster_variants(spark.createDataFrame([(w, n) for n, w in enumerate(words)], "word string, pos long")).collect()
    clusters = {}
    for r in got:
        clusters.setdefault(r["cluster"], {})[r["pos"]] = r["word"]
    assert clusters == {"Marlowe": {0: "Marlowe", 1: "marlow", 2: "Marlo", 3: "merlowe"}, "x" * 40: {0: "x" * 40, 1: "x" * 41}}


def test_within_equals_edit_distance():
    rng = random.Random(8)
    slow = lambda a, b: len(a) or len(b) if not (a and b) else min(slow(a[1:], b) + 1, slow(a, b[1:]) + 1, slow(a[1:], b[1:]) + (a[0] != b[0]))
    for _ in range(400):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(6))) for _ in range(2))
        assert signals._within(a, b, 2) == (slow(a, b) <= 2), (a, b)
        assert slow(a, b) > 2 or signals._deletions(a, 2) & signals._deletions(b, 2)


def test_event_proposals_look_at_one_occupied_span_only(spark):
    segs = segments(spark, ("a", "x", 1.0, 2.0), ("b", "y", 4.0, 5.0))
    ps = spark.createDataFrame([("src", "early", 0.0, 0.5), ("src", "hidden", 6.5, 6.75), ("src", "hit", 4.5, 4.6), ("src", "empty", 3.0, 3.0)], "source_id string, proposal_id string, start_time double, end_time double")
    taken = spark.createDataFrame([("src", 4.25, 9.0), ("src", 6.0, 6.1)], "source_id string, start_time double, end_time double")
    got = {r["proposal_id"]: r["segment_id"] for r in proposals.event_proposals(segs, ps, taken).collect()}
    assert got == {"early": "a", "hidden": "b"}


def test_reanchoring(spark):
    cases = [("abc abc", "abc", 4, 7, 4), ("xx abc", "abc", 0, 3, 3), ("abc - abc", "abc", 5, 8, 6), ("aaa", "aa", 9, 11, 1), ("abcabc", "abc", None, None, 0), ("none", "abc", 0, 3, None)]
    df = spark.createDataFrame(cases, "t string, p string, a int, b int, want int")
    for r in df.select("want", T.reanchor(F.col("t"), F.col("p"), F.col("a"), F.col("b")).alias("r")).collect():
        assert (r["r"] and r["r"]["char_start"]) == r["want"]


def test_word_snapping():
    aligned = [{"s": 0.0, "e": 1.0, "text": "you"}, {"s": 1.0, "e": 2.0, "text": "see"}, {"s": 3.0, "e": 4.0, "text": "it"}]
    assert FW.snap_span("You see, it", 0, 1, 0.0, 4.0, aligned)[:3] == (0.0, 2.0, "fa-word")
    assert FW.snap_span("You know see it", 0, 2, 0.0, 4.0, aligned)[:3] == (0.0, 2.0, "fa-word")
    s, e, kind, words = FW.snap_span("You know see it", 1, 2, 0.0, 4.0, aligned)
    assert kind == "fa-partial" and e == 2.0 and 0.0 <= s < 1.0 and len(words) == 1
    assert FW.snap_span("four plain words here", 1, 1, 0.0, 21.0, None)[:3] == (5.0, 10.0, "estimated")
    assert FW.snap_span("a b", 0, 2, 0.0, 1.0, None) is None and FW.snap_span("a", 0, 0, 1.0, 1.0, None) is None
    assert FW.facing_bound("You see, it", 0, 3, "next", 0.0, 4.0, aligned) == ("see,", 1.0)
    assert FW.facing_bound("You see, it", 0, 3, "prev", 0.0, 4.0, aligned) is None


def test_selectors_refuse_what_is_ambiguous(spark):
    segs = spark.createDataFrame([("s", "r1", None, None, "a", 0), ("s", "r1", "sha256:ab12", "p", "b", 1), ("s", "r1", "sha256:ab99", "", "c", 2)], "source_id string, rendition_id string, skeleton_hash string, split_policy string, id string, idx int")
    spines = selectors.observed_spines(segs)
    assert selectors.choose_spines(spines, "AB9").first()["skeleton_hash"] == "sha256:ab99"
    assert selectors.choose_spines(spines, "legacy").first()["skeleton_hash"] is None
    for bad in (None, "ab", "zz"):
        with pytest.raises(ValueError):
            selectors.choose_spines(spines, bad)
    reds = spark.createDataFrame([("s", "r1", ["x"], False, "X"), ("s", "r2", [], True, None)], "source_id string, id string, chain array<string>, is_raw boolean, preprocessing string")
    assert [r["rendition_id"] for r in selectors.choose_renditions(reds, segs).collect()] == ["r1"]
    assert [r["rendition_id"] for r in selectors.choose_renditions(reds, segs, "raw").collect()] == ["r2"]
    with pytest.raises(ValueError):
        selectors.choose_renditions(reds, segs, "nothing")


def test_gates_null_skeletons_and_ties(spark):
    rows = [("g1", "s", None, "in_progress", 1.0, 1.0, 1), ("g2", "s", None, "signed_off", 2.0, 1.0, 2), ("g3", "s", "h", "excluded", None, None, 3)]
    gates = spark.createDataFrame(rows, "id string, source_id string, skeleton_hash string, extraction_status string, annotated_through double, created_at double, seq long")
    assert {r["id"] for r in overlay.latest_gates(gates).collect()} == {"g2", "g3"}


def test_transfer_duplicates_and_anchors(spark):
    to = segments(spark, ("a", "x", 1.0, 2.0), ("b", "y", 3.0, 4.0))
    donors = spark.createDataFrame([("src", "d1", "inhale", 0.5, 0.6, 0.0), ("src", "d2", "inhale", 2.1, 2.2, 0.0), ("src", "d3", "inhale", 3.5, 3.6, 0.0)], "source_id string, insert_id string, label string, start_time double, end_time double, rank double")
    there = spark.createDataFrame([("src", "i", "inhale", 3.375, True)], "source_id string, id string, label string, start_time double, is_inserted boolean")
    got = {r["insert_id"]: (r["status"], r["after_id"], r["before_id"]) for r in transfer.transfer_plan(donors, there, to).collect()}
    assert got == {"d1": ("unanchored", None, None), "d2": ("transfer", "a", "b"), "d3": ("duplicate", None, None)}


def test_scan_mechanisms(spark):
    segs = segments(spark, ("a", "x", 0.0, 1.0), ("b", "y", 3.0, 4.0))
    words = spark.createDataFrame([("src", 1.5, 1.6, "lost"), ("src", 1.7, 1.8, "words"), ("src", 0.2, 0.4, "home"), ("src", 9.0, 9.1, "tail"), ("src", 2.0, 2.0, "none")], "source_id string, s double, e double, text string")
    full = spark.createDataFrame([("src", 1.25, 2.75)], "source_id string, start_time double, end_time double")
    got = [tuple(r) for r in transfer.scan_mishomed(words, segs, full).orderBy("start_s").select("prev_idx", "next_idx", "words", "text", "mechanism").collect()]
    assert got == [(0, 1, 2, "lost words", "carve-sliver"), (1, -1, 1, "tail", "vad-gap")]


def test_planned_inserts_get_ranks_between_siblings(spark):
    from palimpsest.operators.projection import effective_spine

    segs = segments(spark, ("a", "x", 0.0, 1.0), ("b", "y", 1.0, 2.0), ("c", "z", 1.5, 3.0), ("d", "w", None, None))
    eff = effective_spine(segs, corrections(spark, W.insert_chunk("src", "a", 1.0, 1.0, "s", "b", "i", rank=2.0)), targets(spark))
    got = {r["pos"]: r["p"] for r in planners.with_neighbours(eff).select("pos", planners.plan_chunk_insert().alias("p")).collect()}
    assert (got[0]["rank"], got[0]["welded"], got[0]["after_id"], got[0]["before_id"]) == (1.0, True, "a", "b")
    assert got[1]["rank"] == 3.0 and got[1]["after_id"] == "a"
    assert got[2] is None and got[3] is None and got[4] is None  # an overlap, and rows without times
