"""Resumable file streams and event-time windows."""
