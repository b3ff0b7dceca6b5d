"""Rule statistics of documents and an isolation forest over them, its threshold calibrated from labelled rows.

Anomalies are isolated by few random splits: the mean path length over the trees, as 2 ** (-length / c(sample)), is an anomaly score. The
trees grow over the well-labelled part of a bounded sample: FIT_ROWS labelled documents, those with the least hash of
their id. Splits are drawn over a node's share of the range that the whole sample spans, so a rule that no good document breaks can still
be split on. On the same sample, without what the base rules reject, the threshold is the lowest score that rejects at most MOST_LOST of
the good rows, or a higher one where that splits the labels better. Everything else - statistics, scores, verdicts - is computed for every document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import quoted, table, words

FIT_ROWS, TREES, TREE_ROWS, DEPTH, SEED = 4000, 100, 256, 12, 5
MOST_LOST = 0.001
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbols_a_word", "dup_lines", "repeated", "distinct", "capitals", "marks_a_word", "chars_a_word")
CAPITALS = bytes(range(65, 91))


def repeated_words(ws: list[bytes]) -> tuple[int, int]:
    """How many words lie in 3-word windows that occur twice or more, the first included; how many distinct words there are."""
    numbers = {w: i for i, w in enumerate(dict.fromkeys(ws))}
    if len(ws) < 4:
        return 0, len(numbers)
    ids = np.fromiter(map(numbers.__getitem__, ws), np.int64, len(ws))
    pairs = ids[:-1] * len(numbers) + ids[1:]
    if len(numbers) > 1_500_000:  # else the next product could pass 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(numbers) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ws), bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum()), len(numbers)


def statistics(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The five counts and the features of one text; a null text counts as empty."""
    text = text or ""
    ws = words(text)
    n = len(ws)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    repeated, distinct = repeated_words(ws)
    one = max(n, 1)
    data = text.encode("utf-8", "surrogatepass")
    capitals = (len(data) - len(data.translate(None, CAPITALS))) / max(1, len(text))
    marks = sum(map(text.count, "!?;:\"'()[]{}=/\\_~^@"))
    features = (symbols / one, dup / max(1, len(lines)), repeated / one, distinct / one**0.9, capitals, marks / one, chars / one)
    return (n, chars, symbols, dup, repeated), tuple(math.asinh(20 * x) for x in features)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED_PERCENT * n_words


def usual_length(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary search tree of n keys."""
    return 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: feature (-1: a leaf), split, left child (the right one follows it), path length at a leaf."""

    feature: list[np.ndarray]
    split: list[np.ndarray]
    left: list[np.ndarray]
    length: list[np.ndarray]
    rows: int
    threshold: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores in (0, 1] of feature rows."""
        total, every = np.zeros(len(x)), np.arange(len(x))
        for feature, split, left, length in zip(self.feature, self.split, self.left, self.length, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(64):
                f = feature[node]
                if (f < 0).all():
                    break
                inner = f >= 0
                node = np.where(inner, left[node] + (x[every, np.maximum(f, 0)] >= split[node]), node)
            total += length[node]
        return 2.0 ** (-total / len(self.feature) / max(usual_length(self.rows), 1e-9))


def grow_forest(x: np.ndarray, box: tuple[np.ndarray, np.ndarray], trees: int = TREES, rows: int = TREE_ROWS, depth: int = DEPTH, seed: int = SEED) -> Forest:
    """Trees over random subsets of the rows x; splits are uniform over the part of `box` (least and greatest values) that belongs to a node."""
    rng = np.random.default_rng(seed)
    rows = min(rows, len(x))
    feature, split, left, length = ([] for _ in range(4))
    for _ in range(trees):
        todo = [(0, rng.choice(len(x), rows, replace=False), 0, *box)]
        f, s, to, ends = [-1], [0.0], [0], [0.0]
        while todo:
            node, own, level, low, high = todo.pop()
            open_to = np.flatnonzero(high > low)
            if level == depth or len(own) <= 1 or not len(open_to):
                ends[node] = level + usual_length(len(own))
                continue
            f[node] = at = int(rng.choice(open_to))
            cut = float(rng.uniform(low[at], high[at]))
            s[node] = cut = float(np.nextafter(low[at], high[at])) if cut <= low[at] else cut
            to[node] = len(f)
            right = x[own, at] >= cut
            below, above = high.copy(), low.copy()
            below[at] = above[at] = cut
            todo += [(len(f), own[~right], level + 1, low, below), (len(f) + 1, own[right], level + 1, above, high)]
            f += [-1, -1]
            s += [0.0, 0.0]
            to += [0, 0]
            ends += [0.0, 0.0]
        for all_, one, kind in ((feature, f, np.int64), (split, s, float), (left, to, np.int64), (length, ends, float)):
            all_.append(np.array(one, kind))
    return Forest(feature, split, left, length, rows)


def calibrate(scores: np.ndarray, good: np.ndarray, most_lost: float = MOST_LOST) -> float:
    """Scores above the threshold are rejected: the best split of the labels by balanced accuracy among those that lose at most `most_lost` of the good rows."""
    kept = np.sort(scores[good])
    floor = kept[min(len(kept) - 1, math.ceil(len(kept) * (1 - most_lost)) - 1)] if len(kept) else 1.0
    bad = np.sort(scores[~good])
    cuts = np.unique(np.concatenate([[floor], scores[scores >= floor]]))
    caught = 1 - np.searchsorted(bad, cuts, "right") / max(1, len(bad))
    lost = 1 - np.searchsorted(kept, cuts, "right") / max(1, len(kept))
    best = int(np.argmax(caught - lost))
    above = scores[scores > cuts[best]]
    return float((cuts[best] + above.min()) / 2) if len(above) and (caught - lost)[best] > 0 else float(cuts[best])


def fit(df: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Forest | None:
    """A calibrated forest from at most `rows` labelled documents (null ids or labels are not labelled; an id labelled twice takes its lowest label).

    None without good labelled documents: there's nothing to fit, and only the base rules hold.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.min(label_col).alias("label")).orderBy(F.xxhash64("label_id"), "label_id").limit(rows)
    some = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("label_id"))
    schema = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("features", pa.list_(pa.float64())), ("failed", pa.bool_())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [statistics(t.as_py()) for t in batch.column(1)]
            made = [pa.array([f for _, f in found], pa.list_(pa.float64())), pa.array([base_failed(c[0], c[4]) for c, _ in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), *made], schema=schema)

    measured = some.select("id", "text", F.col("label").cast("int").alias("label")).mapInArrow(run, "id long, label int, features array<double>, failed boolean")
    got = measured.groupBy("id").agg(F.min(F.struct("label", "features", "failed")).alias("x")).select("id", "x.*").orderBy("id").collect()  # `rows` rows at most
    x = np.array([r["features"] for r in got]).reshape(len(got), len(FEATURES))
    good, passed = np.array([r["label"] == 1 for r in got], bool), np.array([not r["failed"] for r in got], bool)
    if not (good & passed).any():
        return None
    forest = grow_forest(x[good & passed], (x[passed].min(0), x[passed].max(0)))
    return replace(forest, threshold=calibrate(forest.score(x[passed]), good[passed]))


def judge(df: DataFrame, forest: Forest | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of `df` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept, beside its own columns.

    kept is false where a base rule fails, else whether the score is at or below the threshold. Null and empty texts have no
    words and fail. Repeated rows and null ids stay; an empty table gives an empty result. Columns of `df` with one of the
    result's names give way to it; any others stay.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    stay = [c for c in df.columns if c.lower() not in new]
    types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
    at = stay.index(text_col)
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(forest)  # TREES trees; DEPTH and TREE_ROWS bound their nodes

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in it:
            if not batch.num_rows:
                continue
            stats, features = zip(*(statistics(t.as_py()) for t in batch.column(at)), strict=True)
            failed = np.array([base_failed(s[0], s[4]) for s in stats], bool)
            score = own.score(np.array(features)) if own else np.zeros(len(stats))
            kept = ~failed & (score <= own.threshold if own else True)
            made = [*zip(*stats, strict=True), failed, score, kept]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(made, types, strict=True))], names=[*stay, *new])

    kept_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*map(quoted, stay)).schema)
    return df.select(*map(quoted, stay)).mapInArrow(run, f"{kept_fields}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs, forest).select("doc_id", *STATS, "base_failed", "kept", "score")
