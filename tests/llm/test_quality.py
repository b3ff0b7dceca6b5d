"""Rule statistics against a plain count, and the forest on labelled rows it has not seen."""

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import quality as Q

DOCS = "doc_id long, text string, kept string, extra long"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet="ab #\n\t\r é", max_size=80))
def test_counts_equal_a_plain_count(text):
    assert Q.statistics(text)[0] == brute(text)


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"{rng.choice('abcdefgh')}{rng.randrange(900)}" for _ in range(3000)]
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        own = [rng.choice(words) for _ in range(rng.randrange(80, 300))]
        if not good:
            own = [w + rng.choice(["###", "$$|", "<>", "!!!"]) if rng.random() < 0.5 else w.upper() for w in own]
        rows.append((i, ". ".join(" ".join(own[k : k + 12]) for k in range(0, len(own), 12)), "clash", i))
        labels.append((i, int(good)))
    return rows, labels


def test_anomalies_go_and_clean_documents_stay(spark):
    rows, labels = corpus(600, 1)
    df, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels[:400], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in Q.judge(df, Q.fit(df, marks)).collect()}
    held = range(400, 600)
    kept_good = [got[i]["kept"] for i in held if labels[i][1]]
    kept_bad = [got[i]["kept"] for i in held if not labels[i][1]]
    assert np.mean(kept_good) >= 0.97 and np.mean(kept_bad) <= 0.1
    assert all(tuple(got[i][c] for c in Q.STATS) == brute(rows[i][1]) for i in range(0, 600, 17))
    assert got[3]["extra"] == 3


def test_the_fit_does_not_depend_on_partitions(spark):
    rows, labels = corpus(200, 2)
    df, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")
    assert Q.fit(df, marks).threshold == Q.fit(df.repartition(5), marks.repartition(3)).threshold


def test_nulls_no_labels_and_empty_tables(spark):
    rows, labels = corpus(30, 3)
    df = spark.createDataFrame([*rows, (None, None, None, None), (1, "", None, None), (1, "too few", None, None), (7, "same words again " * 40, None, None)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.fit(df, none) is None
    got = Q.judge(df, None).collect()
    assert len(got) == 34 and sum(r["base_failed"] for r in got) == 4 and all(r["kept"] != r["base_failed"] for r in got)
    odd = spark.createDataFrame([*labels, (None, 1), (5, None), (5, 0)], "doc_id long, quality int")
    assert len(Q.judge(df, Q.fit(df, odd)).collect()) == 34
    assert Q.judge(spark.createDataFrame([], DOCS), None).collect() == []
