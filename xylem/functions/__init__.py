"""Scalar functions on columns, all built from JVM expressions."""
