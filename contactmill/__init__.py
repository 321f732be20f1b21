"""Contact and lead analytics as Spark DataFrame operators."""
