"""SimHash against brute force: fingerprints, every link within the radius, components, one row of each."""

import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import simhash as S

DOCS = "doc_id long, text string, id string"


def plain_fingerprint(text, k=4):
    words = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(deadline=None)
@given(st.text(alphabet="aB \n\t\u00a0é", max_size=60))
def test_fingerprint_is_the_majority_of_shingle_bits(text):
    assert S.fingerprint(text) == plain_fingerprint(text)


@settings(deadline=None, max_examples=25)
@given(st.integers(0, 2**32), st.integers(0, 7), st.integers(1, 150))
def test_bit_sliced_comparison_finds_every_close_pair(seed, radius, n):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(5)]
    fps = []
    for _ in range(n):
        x = rng.choice(base)
        for _ in range(rng.randrange(8)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps = np.array(fps, np.uint64)
    found = set(zip(*(x.tolist() for x in S.close_pairs(fps, radius)), strict=True))
    assert found == {(i, j) for i in range(n) for j in range(i + 1, n) if int(fps[i] ^ fps[j]).bit_count() <= radius}


def test_every_close_pair_shares_a_block_key():
    rng = random.Random(1)
    for count in (10, 10**5, 10**9):
        masks = S.block_masks(count, 4)
        for _ in range(200):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), 4):
                y ^= 1 << b
            assert any(x & m == y & m for m in masks)


def brute_components(texts):
    ids = [i for i, _ in texts]
    fps = [plain_fingerprint(t) for _, t in texts]
    root = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if (fps[i] ^ fps[j]).bit_count() <= 4 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    least = {r: min(ids[i] for i in range(len(ids)) if root[i] == r) for r in root}
    return sorted((ids[i], f"{fps[i]:016x}", least[root[i]]) for i in range(len(ids)))


def corpus():
    rng = random.Random(7)
    rows = []
    for g in range(6):
        words = [f"w{rng.randrange(3000)}" for _ in range(120)]
        for c in range(4):
            own = list(words)
            if c:
                own[rng.randrange(120)] = f"x{g}{c}"
            rows.append((len(rows) * 3 + 2, " ".join(own)))
    rows += [(100, None), (101, ""), (102, " \n"), (103, "One"), (104, "one"), (1, rows[0][1])]
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], DOCS)
    got = sorted(map(tuple, S.near_duplicates(df).collect()))
    assert got == brute_components(rows)


def test_a_bucket_above_the_part_size_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(S, "PART", 3)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], DOCS)
    assert sorted(map(tuple, S.near_duplicates(df).collect())) == brute_components(rows)


def test_keep_one_keeps_the_least_id_with_all_columns(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, f"c{i}") for i, t in rows] + [(1, rows[0][1], "twin")], DOCS)
    kept = S.keep_one(df).collect()
    want = {c for _, _, c in brute_components(rows)}
    assert sorted(r["doc_id"] for r in kept) == sorted(want)
    assert S.keep_one(df).columns == df.columns


def test_null_ids_ties_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e", None), (5, "a b c d e", None), (5, "a b c d e", None), (None, None, None)], DOCS)
    got = S.near_duplicates(df).collect()
    assert len(got) == 4 and sum(r["component_id"] == 5 for r in got) == 3
    assert [r["component_id"] for r in got if r["fingerprint"] == "0" * 16] == [None]
    empty = spark.createDataFrame([], DOCS)
    assert S.near_duplicates(empty).collect() == [] and S.keep_one(empty).collect() == []


def test_columns_of_any_name_stay_when_one_is_kept(spark):
    names = ["_id", "_hash", "_own_id", "id", "hash", "row", "rows", "own_id", "a.b"]
    rows = [(i, "the same words in a row for all", *[f"{c}{i}" for c in names]) for i in (3, 1, 1, 2)] + [(None, None, *names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    got = S.keep_one(df).collect()
    assert sorted(r["_id"] for r in got) == ["_id", "_id1"] and got[0].__fields__ == ["doc_id", "text", *names]
