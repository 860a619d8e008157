"""A scan engine and corpus operators for PySpark."""
