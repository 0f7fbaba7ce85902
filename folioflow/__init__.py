"""Document-intelligence and retrieval analytics as PySpark DataFrame operators."""
