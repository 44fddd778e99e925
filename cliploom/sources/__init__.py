"""Readers and writers of the formats around the engine: files, probes, project documents, caches, histories, timelines."""
