"""Readers and writers for messages, reports and fitted state."""
