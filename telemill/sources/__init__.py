"""Readers and writers of observations, events, logs and graphs."""
