"""Event-log analytics as Spark DataFrame operators."""
