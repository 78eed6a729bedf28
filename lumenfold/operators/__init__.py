"""Distributed operators: points, statistics, nearest centers and clustering."""
