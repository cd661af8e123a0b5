"""Structured streaming front of the event log."""
