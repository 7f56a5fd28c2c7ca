"""Memory analytics as Spark DataFrame operators."""
