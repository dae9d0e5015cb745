"""Company-event text and signal analytics on PySpark."""
