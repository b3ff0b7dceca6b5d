"""The change log as a stream, and its replay."""
