"""Spark jobs over object listings, task ledgers, URL manifests and status events."""
