"""Ad-log analytics on PySpark: ETL joins, KPI reports, dashboards, series and retrieval."""

__version__ = "0.1.0"
