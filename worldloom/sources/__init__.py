"""Readers: parquet tables with superseded deliveries, textdumps, JSON-lines censuses."""
