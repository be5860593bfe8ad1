"""Assessment-content analytics as Spark DataFrame operators."""
