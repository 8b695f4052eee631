"""Operators on cubes."""
