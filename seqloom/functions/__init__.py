"""Column functions: hashing, scalar text rules and exact arithmetic."""
