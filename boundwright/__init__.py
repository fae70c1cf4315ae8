"""Spark jobs for triaging array-bounds alarms of a static analyser."""
