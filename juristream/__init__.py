"""A PySpark-native engine for versioned document corpora, claims about them, and training-data preparation."""
