"""Sensor-lake analytics on Spark: ingest, resample, profile, segment, score, grade and check machine telemetry."""
