"""Cleaning plans over streams."""
