"""Registered queries, their SQL, and the scan that runs all checks."""
