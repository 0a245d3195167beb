"""Spark jobs for road-traffic detector readings: ingest, cleaning, reports."""
