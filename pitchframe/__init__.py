"""Match-level sports analytics as PySpark DataFrame operators."""
