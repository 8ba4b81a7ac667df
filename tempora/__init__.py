"""Event-graph analytics on PySpark."""
