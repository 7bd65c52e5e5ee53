"""Request-routing and retrieval analytics as Spark DataFrame operators."""
