"""Column functions: paths, unsigned 64-bit arithmetic, hashes, controls."""
