"""Column functions: numbers, text, time ranges and hashes."""
