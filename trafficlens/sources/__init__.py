"""Readers and writers of traffic records and alerts."""
