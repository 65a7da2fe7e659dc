"""A PySpark-native engine for trajectory tables and training-data pipelines."""
