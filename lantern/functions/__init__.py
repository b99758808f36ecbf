"""Part of the retrieval engine."""
