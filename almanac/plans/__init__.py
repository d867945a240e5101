"""Named queries and the archive derived tables."""
