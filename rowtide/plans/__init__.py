"""Derived change logs and the registered queries with their oracles."""
