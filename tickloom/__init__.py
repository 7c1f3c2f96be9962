"""Tick analytics on Spark: validation, enrichment, bars, anomaly scores, data quality and a lake of three layers."""
