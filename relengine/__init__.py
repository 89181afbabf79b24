"""A PySpark-native relational engine for a small, fully specified SQL dialect."""
