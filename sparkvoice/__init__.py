"""sparkvoice: a PySpark-native engine for objective speech evaluation and training-data pipelines."""
