"""Flows as streaming queries, and the tables they write."""
