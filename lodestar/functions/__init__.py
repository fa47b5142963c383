"""Column functions: metrics, hashing, validation."""
