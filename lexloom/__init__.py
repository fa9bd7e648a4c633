"""lexloom: a PySpark-native engine for searching and processing dictionary-style text collections."""
