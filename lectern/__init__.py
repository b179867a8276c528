"""Literature recommendation analytics as Spark DataFrame operators."""
