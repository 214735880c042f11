"""Queries and reference SQL that the driver compares."""
