"""Event-sequence analytics for pitch-by-pitch logs, expressed as Spark DataFrame transforms."""
