"""Column functions: hashes, pointer documents, timestamps and durations."""
