"""Line dedup against a brute-force search for repeated runs of lines."""

import random

from palimpsest.llm import line_dedup as L

DOCS = "doc_id long, text string, key string"


def brute(rows):
    """Lines that go: those in a maximal run, equal to one that stands earlier, with a fingerprint selected in it."""
    docs = sorted({(L.NO_ID if i is None else i, t or "") for i, t in rows}, key=lambda x: (x[0], order_hash(x[1])))
    spots = {}
    for d, (_, text) in enumerate(docs):
        _, keys, at = L.fingerprint_lines(text)
        for k, a in zip(keys, at, strict=True):
            spots.setdefault(k, []).append((d, a))
    gone = {}
    for places in spots.values():
        first = min(places)
        f = docs[first[0]][1].split("\n")
        for d, a in places:
            if (d, a) == first:
                continue
            own = docs[d][1].split("\n")
            same = lambda i, j: 0 <= i < len(own) and 0 <= j < len(f) and own[i].strip(L.SPACES) == f[j].strip(L.SPACES)  # noqa: B023, E731
            lo = hi = 0
            while same(a - lo - 1, first[1] - lo - 1):
                lo += 1
            while same(a + hi, first[1] + hi):
                hi += 1
            gone.setdefault(docs[d], set()).update(range(a - lo, a + hi))
    out = []
    for i, t in rows:
        drop = gone.get((L.NO_ID if i is None else i, t or ""), set())
        lines = t.split("\n") if t is not None else []
        out.append((i, "\n".join(x for n, x in enumerate(lines) if n not in drop) if t is not None else None, len(lines), len(drop) if t is not None else 0))
    return out


HASHES = {}


def order_hash(text):
    return HASHES[text]


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], DOCS)
    HASHES.update({r[0]: r[1] for r in df.selectExpr("coalesce(text, '')", "xxhash64(coalesce(text, ''))").collect()} | {"": df.selectExpr("xxhash64('')").first()[0] if rows else 0})
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_removed_lines"]) for r in L.dedup_lines(df).collect()]
    key = lambda r: tuple(map(repr, r))
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_repeated_runs_equal_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([2, 4, 20]))) for _ in range(60)]
    rows = []
    for i in range(50):
        lines = [rng.choice(pool) if rng.random() < 0.2 else f"own {i} {n}" for n in range(rng.randrange(1, 25))]
        if i % 4 == 0:
            at = rng.randrange(40)
            lines[3:3] = pool[at : at + 9]
        if i % 9 == 0:
            lines += ["", "", ""]
        rows.append((i, "\n".join(lines)))
    rows += [(90, rows[0][1]), (91, rows[0][1])]
    check(spark, rows)


def test_a_common_owner_dealt_in_parts_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(L, "DEALT", 2)
    monkeypatch.setattr(L, "DEALT_KEY", 3)
    line = "a line that is long enough to be a run by itself, with more than sixty-four characters in it"
    check(spark, [(i, f"start {i}\n{line}\nend {i}") for i in range(20)])


def test_nulls_empty_ties_and_repeats(spark):
    text = "one line here\ntwo lines here\nthree lines here\nfour lines here\nfive lines here"
    check(spark, [(1, text), (1, text), (2, text), (None, text), (None, None), (3, ""), (4, None), (5, "\n\n\n\n"), (6, "\n\n\n\n")])
    assert L.dedup_lines(spark.createDataFrame([], DOCS)).collect() == []


def test_the_first_of_two_copies_stays_whole(spark):
    text = "\n".join(f"line {n} of a text" for n in range(9))
    df = spark.createDataFrame([(1, text, "a"), (2, "before\n" + text, "b")], DOCS)
    got = {r["doc_id"]: r for r in L.dedup_lines(df).collect()}
    assert got[1]["text"] == text and got[2]["text"] == "before" and got[2]["n_removed_lines"] == 9 and got[2]["key"] == "b"


def test_every_run_of_guaranteed_length_is_found():
    rng = random.Random(5)
    shared = [f"shared {n}" for n in range(L.RUN + L.WINDOW - 1)]
    for _ in range(50):
        texts = ["\n".join([f"{d}-{rng.random()}" for _ in range(rng.randrange(6))] + shared + [f"{d}-{rng.random()}" for _ in range(rng.randrange(6))]) for d in range(2)]
        a, b = (set(L.fingerprint_lines(t)[1]) for t in texts)
        assert a & b


def every_run(texts, length):
    """Lines of each text in some run of `length` lines that stands earlier, by comparing every two places."""
    seen, gone = set(), []
    for text in texts:
        lines, own = text.split("\n"), set()
        for i in range(len(lines) - length + 1):
            run = tuple(lines[i : i + length])
            if run in seen and any(run):
                own.update(range(i, i + length))
            seen.add(run)
        gone.append(own)
    return gone


def test_all_repeated_runs_go_whoever_owns_their_parts(spark):
    rng = random.Random(7)
    texts = ["\n".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 9))) for _ in range(60)]
    for n in range(40):
        whole = [f"{c} {n}" for c in "wxyz"]
        texts += ["\n".join(x) for x in (whole[1:3], whole, whole)]
    df = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["n_removed_lines"] for r in L.dedup_lines(df).collect()}
    least = every_run(texts, L.RUN + L.WINDOW - 1)
    assert all(got[i] >= len(own) for i, own in enumerate(least))
    assert [got[i] for i in range(62, 180, 3)] == [4] * 40


def all_runs(texts, least):
    """By comparing every two places of all texts: for each text the lines in some run of `least` lines or more that stands earlier, as the longest equal stretch around each place."""
    lines = [t.split("\n") for t in texts]
    gone = [set() for _ in texts]
    places = [(d, i) for d, own in enumerate(lines) for i in range(len(own))]
    for d, i in places:
        for e, j in places:
            if (e, j) >= (d, i) or (i and j and lines[d][i - 1] == lines[e][j - 1]):
                continue  # only from where both begin to be equal
            n = 0
            while i + n < len(lines[d]) and j + n < len(lines[e]) and lines[d][i + n] == lines[e][j + n]:
                n += 1
            if n >= least:
                gone[d].update(range(i, i + n))
    return gone


def removed(spark, texts):
    """Lines that went from each text; lines are told apart by their order, as a text's rest is a subsequence that differs at no line kept."""
    df = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], DOCS)
    return {r["doc_id"]: r for r in L.dedup_lines(df).collect()}


def test_a_short_earlier_occurrence_shields_no_longer_run(spark):
    """The window minimum may be (x, y), whose first occurrence has neither a nor b around it."""
    for n in range(12):
        texts = [f"u1 {n}\nx {n}\ny {n}\nu2 {n}", f"p\na {n}\nx {n}\ny {n}\nb {n}\nq", f"r\na {n}\nx {n}\ny {n}\nb {n}\ns"]
        if n % 4 == 0:
            assert removed(spark, texts)[2]["text"] == "r\ns"
        first = L.fingerprint_lines(texts[1])[1], L.fingerprint_lines(texts[2])[1]
        assert set(first[0]) & set(first[1])


def test_exhaustive_search_over_all_pairs_of_places(spark):
    """Every line in a run of 4 that stands earlier goes; what goes is in a run of 2 that stands earlier, or is a long line that does."""
    rng = random.Random(11)
    pool = ["a", "b", "c", "d", "e", "f", "a line of its own that is longer than sixty-four characters, so that it is a run"]
    texts = ["\n".join(rng.choice(pool) if rng.random() < 0.8 else f"own {rng.random()}" for _ in range(rng.randrange(1, 14))) for _ in range(70)]
    got = removed(spark, texts)
    must, may = all_runs(texts, L.RUN + L.WINDOW - 1), all_runs(texts, L.RUN)
    seen = set()
    for i, text in enumerate(texts):
        lines = text.split("\n")
        long_repeats = {n for n, x in enumerate(lines) if len(x) >= L.SOLO_CHARS and (x in seen or x in lines[:n])}
        seen.update(lines)
        assert len(must[i] | long_repeats) <= got[i]["n_removed_lines"] <= len(may[i] | long_repeats)
        rest = iter(lines)
        assert all(x in rest for x in (got[i]["text"].split("\n") if got[i]["n_removed_lines"] < len(lines) else []))
        kept = [x for n, x in enumerate(lines) if n not in may[i] | long_repeats]
        rest = iter(got[i]["text"].split("\n"))
        assert all(x in rest for x in kept)
    assert sum(len(x) for x in must) > 20


def test_columns_of_any_name_stay(spark):
    names = ["_id", "_hash", "_runs", "id", "hash", "runs", "row", "own_id", "own_hash", "lines", "a.b", "n_lines"]
    text = "\n".join(f"line {n} of a text" for n in range(9))
    df = spark.createDataFrame([(i, text, *[f"{c}{i}" for c in names]) for i in range(2)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    got = sorted(L.dedup_lines(df).collect())
    assert got[0].__fields__ == ["doc_id", "text", *names[:-1], "n_lines", "n_removed_lines"]
    assert [r["text"] for r in got] == [text, ""] and [r["_id"] for r in got] == ["_id0", "_id1"] and got[1]["a.b"] == "a.b1"


def test_blank_runs_take_no_fingerprint_away():
    for n in range(50):
        hashes, keys, _ = L.fingerprint_lines(f"a {n}\n\n\nb {n}")
        assert set(keys) & set(L.run_hashes(hashes).tolist())
