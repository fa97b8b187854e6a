"""Full-text search and corpus analytics as Spark plans."""
