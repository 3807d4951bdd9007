"""Session-evidence analytics as Spark DataFrame operators."""
