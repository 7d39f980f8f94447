"""Text passes over free SQL before Spark plans it."""
