"""Queries over the driver tables: inputs derived by Spark, and the SQL they are checked against."""
