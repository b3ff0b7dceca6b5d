"""Choosing sources, rendition groups and skeletons: over all sources at once, with ambiguity as an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.schemas import LEGACY


def match_sources(sources: DataFrame, needle: str | None = None) -> DataFrame:
    """(id, title) of the source with this id, or those whose title holds `needle` in any case; all without a needle."""
    rows = sources.select("id", F.coalesce("title", F.lit("")).alias("title"))
    return rows.where((F.col("id") == needle) | F.contains(F.lower("title"), F.lower(F.lit(needle)))) if needle else rows


def audio_segments(audio: DataFrame, source_id: str | None = None) -> DataFrame:
    """The coarse spine: ids with their place."""
    rows = audio if source_id is None else audio.where(F.col("source_id") == source_id)
    return rows.select("source_id", "id", "idx")


def rendition_label() -> Column:
    return F.when(F.coalesce("is_raw", F.lit(False)), "raw").otherwise(F.coalesce(F.nullif("preprocessing", F.lit("")), F.nullif(F.array_join("chain", "|"), F.lit("")), F.lit("raw")))


def choose_renditions(renditions: DataFrame, segments: DataFrame, selector: str | None = None) -> DataFrame:
    """source_id, rendition_id of each source's chosen rendition group. `renditions` has source_id beside its own columns.

    Renditions with one chain are a group. 'raw' takes the raw group, another selector the group whose preprocessing holds it in any case
    (of several the one with the least rendition id). Without one it is the group that has segments. ValueError where a selector matches no
    group of a source that has some, or where several groups have segments.
    """
    groups = renditions.select("source_id", F.col("id").alias("rendition_id"), F.coalesce("chain", F.array().cast("array<string>")).alias("chain"), rendition_label().alias("label"), F.coalesce("is_raw", F.lit(False)).alias("is_raw"), F.lower(F.coalesce("preprocessing", F.lit(""))).alias("made_by"))
    if selector is not None:
        hit = F.col("is_raw") if selector.lower() == "raw" else F.contains(F.col("made_by"), F.lit(selector.lower()))
        won = groups.groupBy("source_id").agg(F.min_by("chain", F.when(hit, F.col("rendition_id"))).alias("chain"), F.array_sort(F.collect_set("label")).alias("labels"))
        if bad := won.where("chain IS NULL").orderBy("source_id").first():
            raise ValueError(f"no rendition of {bad['source_id']} matches {selector!r}; there are {bad['labels']}")
    else:
        full = groups.join(segments.select("rendition_id").distinct(), "rendition_id", "left_semi").select("source_id", "chain", "label").distinct()
        won = full.groupBy("source_id").agg(F.min("chain").alias("chain"), F.count_distinct("chain").alias("n"), F.array_sort(F.collect_set("label")).alias("labels"))
        if bad := won.where("n > 1").orderBy("source_id").first():
            raise ValueError(f"several renditions of {bad['source_id']} have segments: {bad['labels']}; choose one")
    return groups.join(won.select("source_id", "chain"), ["source_id", "chain"]).select("source_id", "rendition_id")


def observed_spines(segments: DataFrame) -> DataFrame:
    """source_id, skeleton_hash (null: from before splits), split_policy (the last non-empty one), segments."""
    policy = F.nullif("split_policy", F.lit(""))
    return segments.groupBy("source_id", "skeleton_hash").agg(F.count("*").alias("segments"), F.max_by(policy, F.when(policy.isNotNull(), F.struct("idx", "id"))).alias("split_policy"))


def hash_tail(hash_: Column | str) -> Column:
    return F.substring_index(hash_, ":", -1)


def spine_selector() -> Column:
    """What selects a spine again: its full hash, or 'legacy'."""
    return F.coalesce("skeleton_hash", F.lit(LEGACY))


def spine_tag() -> Column:
    return F.coalesce(F.left(hash_tail("skeleton_hash"), F.lit(8)), F.lit(LEGACY))


def spine_label() -> Column:
    return F.when(F.col("skeleton_hash").isNull(), "vad-only (pre-split)").otherwise(F.concat(F.coalesce("split_policy", F.lit("vad-only")), F.lit(" · "), F.left(hash_tail("skeleton_hash"), F.lit(8))))


def choose_spines(spines: DataFrame, selector: str | None = None) -> DataFrame:
    """source_id, skeleton_hash of the one spine of each source that `selector` names: 'legacy', or the start of a hash or of what follows its last colon.

    ValueError where several spines fit (or are there, without a selector) or none does.
    """
    if selector is None:
        hit = F.lit(True)
    elif selector.lower() == LEGACY:
        hit = F.col("skeleton_hash").isNull()
    else:
        s = F.lit(selector.lower())
        hit = F.coalesce(F.startswith(F.lower("skeleton_hash"), s) | F.startswith(F.lower(hash_tail("skeleton_hash")), s), F.lit(False))
    counted = spines.withColumn("_hit", hit).groupBy("source_id").agg(F.count_if("_hit").alias("hits"), F.array_sort(F.collect_list(spine_label())).alias("labels"))
    if bad := counted.where("hits <> 1").orderBy("source_id").first():
        raise ValueError(f"{bad['hits']} spines of {bad['source_id']} fit {selector!r}: {bad['labels']}")
    return spines.where(hit).select("source_id", "skeleton_hash")


def skeleton_hash_for(segments: DataFrame, selector: str | None = None) -> str | None:
    """The hash of the one spine of one source that `selector` names; None for one from before splits, or without any."""
    found = choose_spines(observed_spines(segments), selector).first()
    return found and found["skeleton_hash"]


def source_spines(segments: DataFrame, renditions: DataFrame | None = None, rendition: str | None = None) -> DataFrame:
    """observed_spines() of the chosen renditions of each source; no rows where nothing is there."""
    return observed_spines(spine(segments, renditions, rendition))


def spine(segments: DataFrame, renditions: DataFrame | None = None, rendition: str | None = None, skeleton: str | None = None, one: bool = False) -> DataFrame:
    """Segments of the chosen renditions and, with `one` or a skeleton, of one spine of each source."""
    rows = segments
    if renditions is not None:
        rows = rows.join(choose_renditions(renditions, segments, rendition), ["source_id", "rendition_id"], "left_semi")
    if one or skeleton is not None:
        chosen = choose_spines(observed_spines(rows), skeleton).withColumnsRenamed({"source_id": "_s", "skeleton_hash": "_h"})
        rows = rows.join(chosen, (F.col("source_id") == F.col("_s")) & F.col("skeleton_hash").eqNullSafe(F.col("_h")), "left_semi")
    return rows


def page(segments: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """One reader's page of a spine in its order."""
    rows = segments.orderBy("idx", "id").offset(offset)
    return rows if limit is None else rows.limit(limit)


def empty_segments(segments: DataFrame) -> DataFrame:
    """Segments with null or '' for a text. White space alone is not selected here, though is_blank() holds for it."""
    return segments.where("text = '' OR text IS NULL")
