"""Support-message analytics expressed as PySpark DataFrame operators."""
