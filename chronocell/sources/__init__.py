"""Readers, the change-log store and shared scratch tables."""
