"""Device telemetry on Spark: ingest, registry, presence, admission, fleet and packet jobs."""
