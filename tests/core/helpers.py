"""Small tables for the overlay's tests."""

from palimpsest.operators.writers import correction
from palimpsest.schemas import schema
from palimpsest.sources.store import rows_of

SEGMENT = "source_id string, id string, idx int, text string, start_time double, end_time double"


def segments(spark, *rows, source="src"):
    """(id, text, start, end) in order."""
    return spark.createDataFrame([(source, r[0], i, r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None) for i, r in enumerate(rows)], SEGMENT)


def corrections(spark, *batches):
    """The correction rows of batches (or plain rows), with rising times."""
    rows = [r for b in batches for r in (b.rows["correction"] if hasattr(b, "rows") else [b])]
    return rows_of(spark, "correction", [{**r, "created_at": float(n), "seq": n} for n, r in enumerate(rows)]) if rows else spark.createDataFrame([], schema("correction"))


def targets(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "target_id string")


def dead_of(spark, *batches):
    return targets(spark, *[e["target_id"] for b in batches for e in b.rows.get("edge", []) if e["relation_type"] == "SUPERSEDES"])


def spine_of(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.orderBy("source_id", "pos").collect()]


__all__ = ["correction", "corrections", "dead_of", "segments", "spine_of", "targets"]
