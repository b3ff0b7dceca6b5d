"""Verdicts on proposed events: a one-to-one match of proposals with what humans inserted."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.lineage import cut
from palimpsest.operators.groups import fold_groups
from palimpsest.operators.ordering import bucket_of, scan

KEYS = ["source_id"]
# fixed values
RADIUS, TOLERANCE = 2.0, 0.15
VERDICTS = ("accepted", "edited", "relabeled", "rejected", "unaccepted")


def match(proposals: DataFrame, inserts: DataFrame, window: tuple[float, float | None] = (0.0, None), radius: float = RADIUS, keys: list[str] = KEYS) -> DataFrame:
    """keys, proposal_id, insert_id of matched pairs.

    Candidates are labelled inserts that start in `window`. Pairs whose midpoints are less than `radius` apart match nearest first, each row
    once: pairs of one label, then of any; all of tier 1 (null tiers too), then tier 2. Of equal distances the earlier proposal
    counts, then the earlier insert. Rows that lie `radius` or more apart in time can't affect each other, so the sequential part runs in islands of time.
    """
    mid = (F.col("start_time") + F.col("end_time")) / 2
    at = F.col("start_time") >= window[0]
    if window[1] is not None:
        at &= F.col("start_time") < window[1]
    shape = [*keys, "kind", "id", "label", "start_time", "end_time", "tier"]
    own = proposals.withColumns({"kind": F.lit(0), "id": F.col("proposal_id"), "tier": F.coalesce("tier", F.lit(1)).cast("int")}).where("tier IN (1, 2)").select(*shape)
    human = inserts.where("label <> ''").where(at).withColumns({"kind": F.lit(1), "id": F.col("insert_id"), "tier": F.lit(0)}).select(*shape)
    rows = own.unionByName(human).where("start_time IS NOT NULL AND end_time IS NOT NULL").withColumn("mid", mid)
    order = ["mid", "kind", "id"]
    rows = scan(cut(rows), keys, order, {"_before": ("last", F.col("mid"))}, bucket_of("mid"))
    rows = rows.withColumn("_opens", F.when(F.col("_before").isNull() | (F.col("mid") - F.col("_before") >= radius), F.col("mid")))
    rows = scan(rows, keys, order, {"_home": ("last", F.col("_opens"))}, bucket_of("mid")).withColumn("island", F.coalesce("_opens", "_home"))

    def greedy(key: tuple, island: list[tuple]) -> list[tuple]:
        """Candidates are met by a sweep over midpoints, so the work is that of pairs closer than the radius, however long the island is."""
        out: list[tuple] = []
        free = {n: r for n, r in enumerate(island) if r[0] == 1}
        humans = sorted((r[7], n) for n, r in free.items())
        mids = [m for m, _ in humans]
        for tier in (1, 2):
            open_ = {n: r for n, r in enumerate(island) if r[0] == 0 and r[6] == tier}
            met = [(abs(m - p[7]), i, j) for i, p in open_.items() for m, j in humans[bisect_left(mids, p[7] - radius) : bisect_right(mids, p[7] + radius)] if j in free and abs(m - p[7]) < radius]
            for same in (True, False):
                for _, i, j in sorted(x for x in met if x[1] in open_ and x[2] in free and (not same or free[x[2]][2] == open_[x[1]][2])):
                    if i in open_ and j in free:
                        out.append((*key[:-1], open_.pop(i)[1], free.pop(j)[1]))
        return out

    kinds = dict(rows.dtypes)
    # proposals by start and id, inserts by start, end and id: the order that breaks ties
    rows = rows.withColumn("by_end", F.when(F.col("kind") == 1, F.col("end_time")).otherwise(0.0))
    rows = rows.select(*keys, "island", "kind", "id", "label", "start_time", "by_end", "end_time", "tier", "mid")
    return fold_groups(rows, [*keys, "island"], ["kind", "start_time", "by_end", "id"], greedy, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "proposal_id string", "insert_id string"]))


class Bench:
    """verdicts (a row for each proposal of tier 1 or 2), missed (candidates without one), counts (by tier and verdict, with rates in tier 1)."""

    def __init__(self, proposals: DataFrame, inserts: DataFrame, window: tuple[float, float | None] = (0.0, None), tolerance: float = TOLERANCE, keys: list[str] = KEYS) -> None:
        inserts = cut(inserts.select(*keys, "insert_id", "label", "start_time", "end_time"))
        pairs = cut(match(proposals, inserts, window, keys=keys))
        score = F.col("score") if "score" in proposals.columns else F.lit(None).cast("double")
        rows = proposals.withColumns({"tier": F.coalesce("tier", F.lit(1)).cast("int"), "score": score}).where("tier IN (1, 2)").select(*keys, "proposal_id", "label", "start_time", "end_time", "score", "tier")
        humans = inserts.select(*keys, "insert_id", F.col("label").alias("insert_label"), F.col("start_time").alias("insert_start"), F.col("end_time").alias("insert_end"))
        rows = rows.join(pairs, [*keys, "proposal_id"], "left").join(humans, [*keys, "insert_id"], "left")
        near = (F.abs(F.col("insert_start") - F.col("start_time")) <= tolerance) & (F.abs(F.col("insert_end") - F.col("end_time")) <= tolerance)
        none = F.when(F.col("tier") == 1, "rejected").otherwise("unaccepted")
        verdict = F.when(F.col("insert_id").isNull(), none).when(~F.col("label").eqNullSafe(F.col("insert_label")), "relabeled").when(near, "accepted").otherwise("edited")
        self.verdicts = rows.withColumn("verdict", verdict)
        at = F.col("start_time") >= window[0]
        if window[1] is not None:
            at &= F.col("start_time") < window[1]
        self.missed = inserts.where("label <> ''").where(at).select(*keys, "insert_id", "label", "start_time", "end_time").join(pairs, [*keys, "insert_id"], "left_anti")
        counted = self.verdicts.groupBy(*keys, "tier", "verdict").agg(F.count("*").alias("n"))
        total = counted.groupBy(*keys, "tier").agg(F.sum("n").alias("proposals"))
        rate = F.when(F.col("tier") == 1, F.bround(F.col("n") / F.col("proposals"), 4))
        self.counts = counted.join(total, [*keys, "tier"]).withColumn("rate", rate)
