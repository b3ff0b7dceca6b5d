"""What moves between tasks follows the input: bytes written to shuffles, and columns that reach them."""

import random
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.catalog.views import Views
from palimpsest.functions import text as T
from palimpsest.functions import words as FW
from palimpsest.lineage import cut, scratch
from palimpsest.operators import projection as P
from palimpsest.operators import signals
from palimpsest.operators import writers as W
from palimpsest.sources import readers
from tests.core.helpers import SEGMENT, corrections, targets


def _shuffled(spark):
    time.sleep(0.2)  # the store is brought up to date ten times a second at most
    spark.range(1).count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def moved(spark, build):
    """Bytes that `build()` and its rows write to shuffles."""
    before = _shuffled(spark)
    build().write.format("noop").mode("overwrite").save()
    return _shuffled(spark) - before


def test_a_variant_text_is_dealt_once_and_not_for_each_slice(spark):
    text = "".join(random.Random(1).choices("abcdefghijklmnop", k=100_000))
    slices = "id string, text_slices array<struct<transcript: string, start: int, end: int>>"
    segments = spark.createDataFrame([(f"s{i}", [("t", 0, 100_000), ("t", i, 100_000)]) for i in range(100)], slices)
    transcripts = spark.createDataFrame([("t", text, "a")], "id string, text string, transcriber string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert moved(spark, lambda: readers.variant_texts(segments, transcripts)) < 1_000_000
        got = {r["segment_id"]: (r["transcriber"], r["variant_text"], r["pos"]) for r in readers.variant_texts(segments, transcripts).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {f"s{i}": ("a", text[i:], 0) for i in range(100)}


def _spine(spark, n=200, size=10_000):
    """Segments with texts that don't compress to less than half, with some edits of each kind."""
    r = random.Random(2)
    segs = cut(spark.createDataFrame([("src", f"s{i:03}", i, "".join(r.choices("abcdefghijklmnop", k=size)), float(i), i + 1.0) for i in range(n)], SEGMENT))
    made = [W.replace_text("src", "s001", "new", "s"), W.insert_chunk("src", "s002", 3.0, 3.0, "s", label="i"), W.nudge_times("src", [{"segment_id": "s003", "edge": "end", "old_time": 4.0, "new_time": 4.5}], "s"), W.prune("src", ["s004"], "s")]
    return segs, corrections(spark, *made), targets(spark)


@pytest.fixture
def unbroadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_effective_spine_deals_each_text_once(unbroadcast):
    segs, made, dead = _spine(unbroadcast)
    assert moved(unbroadcast, lambda: P.effective_spine(segs, made, dead)) < 3_000_000


def test_places_are_found_without_texts(unbroadcast):
    segs, made, dead = _spine(unbroadcast)
    assert moved(unbroadcast, lambda: P.place(segs, P.active_edits(made, dead))) < 200_000
    got = P.place(segs, P.active_edits(made, dead)).where("is_inserted OR pos < 2").orderBy("pos").select("pos", "id", "text").collect()
    assert [tuple(r)[:2] for r in got][:2] == [(0, "s000"), (1, "s001")] and [r["text"] for r in got] == [None, None, ""]


def test_lines_stay_with_their_document(spark, tmp_path):
    r = random.Random(3)
    texts = ["\n".join("".join(r.choices("abcdéfgh ", k=50)) for _ in range(100)) for _ in range(100)] + ["", "\n\n", "x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    assert moved(spark, lambda: Views(spark, str(tmp_path)).view("fix_segment")) < 100_000
    got = {(x["source_id"], x["idx"]): (x["text"], x["start_time"] * 16, x["end_time"] * 16) for x in Views(spark, str(tmp_path)).segments.collect()}
    for d, t in enumerate(texts):
        at = 0
        for i, line in enumerate(t.split("\n")):
            assert got.pop((d, i)) == ("" if i % 7 == 3 else line, at, at + len(line))
            at += len(line) + 1
    assert not got


def test_a_cut_table_is_not_written_again(spark):
    table = cut(spark.range(3).toDF("x"))
    assert cut(table) is table
    with scratch(spark) as out:
        held = cut(spark.range(3).toDF("x"))
        kept = out(held)
    assert kept is not held and kept.count() == 3


def test_words_are_split_once_where_a_filter_asks_for_them(spark):
    df = spark.createDataFrame([(" a  b c", 0), ("d", 1), (None, 2)], "text string, n int").withColumn("w", T.word_spans(F.col("text"))).where(F.size("w") >= 1)
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [[tuple(w) for w in r["w"]] for r in df.orderBy("n").collect()] == [[(1, 2, "a"), (4, 5, "b"), (6, 7, "c")], [(0, 1, "d")]]


def test_batches_of_snaps_equal_those_of_single_rows(spark):
    r = random.Random(4)
    rows = []
    for n in range(300):
        words = r.choices(["ab", "Cé", "d.", "ef", "g"], k=r.randrange(7))
        start = None if n % 17 == 0 else float(r.randrange(4))
        aligned = None if n % 11 == 0 else [(s := r.randrange(40) / 8, s + r.choice([0, 0.25, 1]), w) for w in r.choices([*words, "zz"], k=r.choice([len(words), r.randrange(7)]))]
        i, j = sorted(r.choices(range(6), k=2))
        rows.append((n, r.choice([" ", "  "]).join(words) if n % 13 else None, i, j, r.randrange(8), r.randrange(8), start, None if n % 19 == 0 else 5.0, aligned))
    df = spark.createDataFrame(rows, "n int, text string, first_word int, last_word int, char_start int, char_end int, start_time double, end_time double, aligned array<struct<s: double, e: double, text: string>>").repartition(3)
    snaps = {x["n"]: x for x in FW.snap_words(df).collect()}
    facing = {side: {x["n"]: (x["neighbour_word"], x["neighbour_time"]) for x in FW.facing_bounds(df, side).collect()} for side in ("next", "prev", "none")}
    kinds = set()
    for n, text, i, j, c, d, start, end, aligned in rows:
        aligned = aligned and [{"s": a[0], "e": a[1], "text": a[2]} for a in aligned]
        want, got = FW.snap_span(text, i, j, start, end, aligned), snaps[n]
        kinds.add(want and want.snap)
        assert (got["start_s"], got["end_s"], got["snap"]) == (want[:3] if want else (None, None, None))
        assert (got["words"] is None) == (want is None) and (want is None or [w.asDict() for w in got["words"]] == want.words)
        for side, told in facing.items():
            assert told[n] == (FW.facing_bound(text, c, d, side, start, end, aligned) or (None, None))
    assert kinds == {None, "fa-word", "fa-partial", "estimated"}


def test_reanchoring_is_linear_in_the_text(spark):
    r = random.Random(6)
    rows = [("".join(r.choices("ab", k=r.randrange(12))) if n % 9 else None, "".join(r.choices("ab", k=r.randrange(4))) if n % 8 else None, None if n % 7 == 0 else r.randrange(-2, 14), None if n % 6 == 0 else r.randrange(14)) for n in range(600)]
    shape = "t string, p string, a int, b int"
    told = lambda rows: [tuple(x) for x in spark.createDataFrame([(n, *x) for n, x in enumerate(rows)], f"n int, {shape}").select("n", T.reanchor(F.col("t"), F.col("p"), F.col("a"), F.col("b")).alias("r")).orderBy("n").select("r.char_start", "r.char_end").collect()]
    for (t, p, a, b), got in zip(rows, told(rows), strict=True):
        t = t or ""
        places = [i for i in range(len(t)) if p and t.startswith(p, i)]
        at = a if p and a is not None and b is not None and 0 <= a < b and t[a:b] == p else min(places, key=lambda i: (abs(i - a) if a is not None and a >= 0 else i, i), default=None)
        assert got == ((None, None) if at is None else (at, at + len(p))), (t, p, a, b)
    long = "x" * 1_000_000  # a substring for each place of it takes minutes
    began = time.time()
    assert told([(long + "aab", "ab", 5, 7), ("ab" + long, "ab", 1_000_000, 1_000_002)]) == [(1_000_001, 1_000_003), (0, 2)]
    assert time.time() - began < 30


def test_sounds_are_asked_of_distinct_words_only(spark):
    words = spark.createDataFrame([(w, n) for n, w in enumerate(["Maier", " mayer", "Maier", "", "12", None, "zwei", "Meier", "mayer "])], "word string, pos int")
    rows = signals.cluster_variants(words)
    plan = rows._jdf.queryExecution().optimizedPlan().toString().split("\n")
    below = "\n".join(plan[max(i for i, x in enumerate(plan) if "Aggregate" in x) + 1 :])  # what is done with each place of a word
    assert "regexp_replace" not in below and "translate" not in below
    assert sorted(tuple(r) for r in rows.collect()) == [("Maier", 0, "Maier"), ("Maier", 1, "mayer"), ("Maier", 2, "Meier")]
