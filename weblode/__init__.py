"""Web-server log analytics as Spark DataFrame operators."""
