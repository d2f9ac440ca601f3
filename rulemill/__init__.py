"""Spark jobs for building and serving a searchable rulebook corpus."""
