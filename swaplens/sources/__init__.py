"""Readers and writers, and the session plumbing they share."""
