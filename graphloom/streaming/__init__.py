"""Streaming of graphloom."""
