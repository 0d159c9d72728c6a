"""Column functions and the small NumPy helpers that run inside Arrow tasks."""
