"""Queries over the driver tables, one for each operator or group of operators."""
