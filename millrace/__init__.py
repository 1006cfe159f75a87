"""millrace: a PySpark-native engine for resolving, merging, scoring and monitoring product data."""
