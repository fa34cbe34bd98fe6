"""Spark-first analytics over time-stamped evidence and multi-reviewer verdicts."""
