"""Readers and writers: offer CSVs, tender JSON, snapshots, upserts, logs, state."""
