"""The pipeline against its stages done by brute force, one after the other."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from palimpsest.llm import pieces, quality
from tests.llm import test_decontaminate, test_line_dedup, test_simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(12)
    words = [f"{rng.choice('abcdefgh')}{n}" for n in range(2000)]
    text = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(9)) for _ in range(n))
    items = [(n, " ".join(rng.choice(words) for _ in range(40))) for n in range(3)]
    shared = text(5)
    docs = []
    for i in range(60):
        own = text(rng.randrange(8, 16))
        if i % 10 == 3:
            own = " ".join(w + "###$$$" for w in own.split())
        if i % 10 == 5:
            own = f"{own}\n{shared}"
        if i % 20 == 7:
            own = own + "\n" + items[i // 20][1]
        docs.append((i * 2, own))
    lines = docs[2][1].split("\n")
    docs += [(206, "\n".join([*lines[:4], "one line is another one here", *lines[4:]]))]
    near = docs[0][1].split(" ")
    near[30] = "changed"
    docs += [(200, docs[1][1]), (201, " ".join(near).replace("\n", " ")), (202, docs[0][1].replace("\n", " ")), (203, None), (204, "too short"), (205, ""), (200, docs[1][1])]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(n % 10 != 3)) for n, (i, _) in enumerate(docs[:50])], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, items


def brute(spark, docs, items, forest):
    kept = []
    for i, t in docs:
        stats, features = quality.statistics(t)
        if not quality.base_failed(stats[0], stats[4]) and forest.score(np.array([features]))[0] <= forest.threshold:
            kept.append((i, t))
    hashes = spark.createDataFrame(kept, "doc_id long, text string").selectExpr("coalesce(text, '')", "xxhash64(coalesce(text, ''))").collect()
    test_line_dedup.HASHES.update({r[0]: r[1] for r in hashes})
    kept = [(i, t) for i, t, n, gone in test_line_dedup.brute(kept) if not gone or len(t.split()) >= 50]
    groups = {}
    for (i, t), (_, _, root) in zip(sorted(kept, key=lambda x: x[0]), sorted(test_simhash.brute_components(kept), key=lambda x: x[0]), strict=True):
        groups.setdefault(root, []).append((i, t))
    kept = [min(g, key=lambda x: x[0]) for g in groups.values()]
    kept = [(i, t) for i, t in kept if not test_decontaminate.brute(t, items)]
    library = pieces.MergeModel(pieces.public_model()).library
    return {i: hashlib.sha256(" ".join(map(str, [*library.encode(t), 2])).encode()).hexdigest() for i, t in kept}


def test_run_equals_brute_force(spark, folder):
    path, docs, items = folder
    table = spark.read.parquet(f"{path}/documents.parquet")
    forest = quality.fit(table, spark.read.parquet(f"{path}/labels.parquet"))
    got = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, path).collect()}
    want = brute(spark, docs, items, forest)
    assert got == want
    assert 30 < len(got) < 60 and not {203, 204, 205, 202, 206} & set(got)


def test_stages_keep_the_columns_and_take_empty_tables(spark, folder):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    empty = docs.limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, empty, path)
        assert out.collect() == []
        assert k == len(corpus_pipeline.STAGES) - 1 or out.schema.simpleString() == docs.schema.simpleString()


def test_the_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup", "benchmark decontamination", "SentencePiece encoding and decoding"]
