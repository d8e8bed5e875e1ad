"""carelake: hospital analytics expressed as Spark DataFrame jobs.

Layers
------
sources/    typed schemas, readers (parquet/csv/json), the test-data adapter, sinks
functions/  Column-level helpers (dialect traps, masking policies)
operators/  reusable DataFrame operators (calendar, stay-day expansion, band
            lookup, top-k, pivot, control chart, forecast, anomaly, drivers)
plans/      marts, feature views, named queries, semantic layer, quality
            checks, alerts, governance and the refresh pipeline
streaming/  file-stream form of the bed-status event source
"""

__all__ = ["session", "config"]
