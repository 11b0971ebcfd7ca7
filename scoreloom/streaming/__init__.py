"""Landed files as streams."""
