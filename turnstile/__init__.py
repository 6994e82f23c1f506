"""Event-ticketing analytics as PySpark DataFrame operators."""
