"""The change log as a stream, and state rebuilt by replaying it: in batch, or batch by batch from Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.ordering import latest_by
from palimpsest.schemas import schema
from palimpsest.sources.store import OverlayStore

# fixed values
WIRE_VERBS = (
    "session-start", "boundary-shift", "text-correction", "prune", "prune-amendment", "mark", "mark-dismiss", "review-markers", "time-nudge", "chunk-insert", "chunk-insert-remove",
    "chunk-split", "chunk-split-remove", "reject", "speech-overlay", "speech-overlay-remove", "speaker-entity", "speaker-assign", "extraction-gate",
)
UPDATE_VERBS = ("session-status", "session-purpose", "entity-rename")
REPLAYED = ("correction", "edge", "session", "entity", "gate")


def journal_stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the change log as they are appended."""
    return spark.readStream.schema(schema("journal")).json(path)


def wires(lines: DataFrame, table: str) -> DataFrame:
    """The rows of a table that these lines carry, one for each id (sessions and entities: for each change)."""
    key = ["id", "seq"] if table in ("session", "entity") else ["id"]
    carried = lines.where(F.col("verb").isin(*WIRE_VERBS, *UPDATE_VERBS) & F.col("wires").isNotNull())
    rows = carried.select(F.explode(F.from_json(F.get_json_object("wires", f"$.{table}"), f"array<{schema(table).simpleString()}>")).alias("r")).select("r.*").where("id IS NOT NULL")
    return rows.dropDuplicates(key)


def replay(lines: DataFrame) -> dict[str, DataFrame]:
    """All tables that a change log rebuilds. Lines may come twice; the latest row of a session or an entity counts."""
    out = {t: wires(lines, t) for t in REPLAYED}
    for t in ("session", "entity"):
        out[t] = latest_by(out[t], ["id"], [F.coalesce("updated_at", F.lit(0.0)), "seq"])
    return out


def replay_stream(spark: SparkSession, path: str, root: str, checkpoint: str) -> StreamingQuery:
    """Replay new lines into the workspace at `root` as they come. Appends are idempotent by id, so a batch that runs again after a failure adds nothing."""
    store = OverlayStore(spark, root)

    def apply(batch: DataFrame, _: int) -> None:
        for t in REPLAYED:
            store.append(t, wires(batch, t))

    return journal_stream(spark, path).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()


def activity(lines: DataFrame) -> DataFrame:
    """session_id, ops, first_ts, last_ts, seconds of each session in the log, from the times of the rows its lines carry."""
    at = F.from_json(F.get_json_object("wires", "$.correction"), "array<struct<created_at: double>>")
    rows = lines.where("`set` IS NOT NULL").select(F.col("set").alias("session_id"), F.array_max(F.transform(at, lambda c: c["created_at"])).alias("ts"))
    return rows.groupBy("session_id").agg(F.count("*").alias("ops"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).withColumn("seconds", F.col("last_ts") - F.col("first_ts"))


def live_counts(stream: DataFrame, window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Operations by verb and window of the time they were made, on a stream or a table; later ones than `delay` are not counted."""
    at = F.timestamp_seconds(F.array_max(F.transform(F.from_json(F.get_json_object("wires", "$.correction"), "array<struct<created_at: double>>"), lambda c: c["created_at"])))
    rows = stream.select("verb", at.alias("at")).where("at IS NOT NULL")
    return rows.withWatermark("at", delay).groupBy(F.window("at", window), "verb").agg(F.count("*").alias("ops")).select(F.col("window.start").alias("window_start"), "verb", "ops")
