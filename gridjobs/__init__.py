"""Spark jobs that cluster large point tables on regular grids."""
