"""Scalar functions as Column expressions; nearly all of them stay in generated JVM code."""
