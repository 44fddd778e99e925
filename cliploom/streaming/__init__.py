"""Structured Streaming forms; an extension, as the batch engine has no streams of its own."""
