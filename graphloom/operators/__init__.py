"""Operators of graphloom."""
