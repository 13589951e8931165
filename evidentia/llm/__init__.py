"""Operators for preparing language-model training data on Spark.

Nothing outside this folder imports it; the driver contract adds its queries
only where it can be imported.
"""
