"""Joins, radix partitioning, scans and reductions over relations."""
