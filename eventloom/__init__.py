"""Event-log and process-model analytics as Spark DataFrame operators."""
