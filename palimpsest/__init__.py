"""palimpsest: transcripts as immutable segments under an append-only overlay of corrections, queried with Spark."""
