"""Readers and writers, and the record parser that keeps what it rejects."""
