"""Document analytics written on the PySpark DataFrame API."""
