"""Readers of landed change files and the event log."""
