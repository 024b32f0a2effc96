"""A PySpark-native analytics engine for raw bytes, text and float tensors."""
