"""Event-stream analytics on PySpark."""
