"""Latency analytics on Spark: traces, request logs and evidence, many runs per job."""
