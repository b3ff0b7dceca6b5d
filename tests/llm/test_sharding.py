"""Shards: the laws and the mixture."""

import zlib
from collections import Counter, defaultdict

from palimpsest.llm import sharding as S

DOCS = "doc_id long, text string, source string, shard string, part long"


def test_rows_law_slots_and_mixture(spark):
    rows = [(i, f"text {i}" * (i % 5), "big" if i % 3 else f"s{i % 6}", "clash", 1) for i in range(1003)] + [(None, None, None, None, None)] * 3
    got = S.interleave(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by = Counter((r["shard"], r["source"]) for r in got)
    for source, n in Counter(r["source"] for r in got).items():
        assert all(abs(by[s, source] - n / 8) <= 2 for s in range(8)), source


def test_equal_to_a_plain_sort_by_fractional_rank(spark, monkeypatch):
    """With buckets of any number: each source sorted by its seeded hash as an unsigned number, all rows sorted by (rank - 1/2) / rows, cut into equal runs."""
    rows = [(i, f"text {i % 50}", ["big", "mid", None][min(2, i % 7 // 3)], None, None) for i in range(500)] + [(7, "same", "mid", None, None)] * 4
    df = spark.createDataFrame(rows, DOCS)
    hashed = df.selectExpr("xxhash64(17, doc_id, cast(crc32(text) as bigint), cast(octet_length(text) + 1 as bigint)) AS h", "doc_id", "crc32(text) AS crc", "octet_length(text) + 1 AS size", "source").collect()
    of = defaultdict(list)
    for r in hashed:
        of[r["source"]].append((r["h"], r["doc_id"], r["crc"], r["size"]))
    every = sorted(((n + 0.5) / len(own), *x) for own in of.values() for n, x in enumerate(sorted(own, key=lambda x: (x[0] % 2**64, *x[1:]))))
    cut = [-(-s * len(every) // 8) for s in range(9)]
    want = sorted((x[2], x[3], s, n) for s in range(8) for n, x in enumerate(every[cut[s] : cut[s + 1]]))
    for rows_each in (50_000, 1):
        monkeypatch.setattr(S, "BUCKET_ROWS", rows_each)
        monkeypatch.setattr(S, "SOURCE_BITS", 2)
        monkeypatch.setattr(S, "FRACTION_BITS", 3)
        assert sorted((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in S.interleave(df).collect()) == want


def test_the_order_depends_on_the_seed_and_nothing_else(spark):
    df = spark.createDataFrame([(i, f"t{i}", "a", None, None) for i in range(100)], DOCS)
    place = lambda d, seed: {r["doc_id"]: (r["shard"], r["slot"]) for r in S.interleave(d, seed=seed).collect()}
    assert place(df, 1) == place(df.repartition(7), 1) != place(df, 2)


def test_ties_small_and_empty_tables(spark):
    same = spark.createDataFrame([(1, "x", "a", None, None)] * 5, DOCS)
    assert sorted((r["shard"], r["slot"]) for r in S.interleave(same).collect()) == [(s, 0) for s in (0, 1, 3, 4, 6)]
    assert S.interleave(spark.createDataFrame([], DOCS)).collect() == []
