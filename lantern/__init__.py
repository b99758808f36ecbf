"""A PySpark-native retrieval and analytics engine."""
