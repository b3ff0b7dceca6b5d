"""Column functions: text rules of transcripts, and word alignment."""
