"""Operators over telemetry tables; each takes and returns DataFrames and runs nothing itself."""
