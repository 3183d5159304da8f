"""Streams of recorded sessions."""
