"""Operators: each a function ``DataFrame -> DataFrame`` built from Spark built-ins."""
