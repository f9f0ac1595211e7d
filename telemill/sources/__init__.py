"""Scans, sinks, ingest and snapshots."""
