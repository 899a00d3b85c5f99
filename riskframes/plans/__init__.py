"""Runners that compose operators into registered evaluations."""
