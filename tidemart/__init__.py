"""tidemart: a real-time commerce warehouse as Spark DataFrame transforms."""
