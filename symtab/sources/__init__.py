"""Archives and caches as tables."""
