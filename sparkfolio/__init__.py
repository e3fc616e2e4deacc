"""A PySpark-native engine for document layout and text analytics."""
