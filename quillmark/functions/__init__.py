"""Scalar functions: each takes and returns Spark columns, and stays in the JVM."""
