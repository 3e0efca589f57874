"""tessera: a PySpark-native engine for detection streams and hybrid text retrieval."""
