"""Registered queries over the supplied tables, the adapters that feed them, and their SQL counterparts."""
