"""A PySpark-native engine for prescription text, pair joins, severity logic and evaluation analytics."""
