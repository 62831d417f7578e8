"""Streaming forms of sessions, first samples and band joins."""
