"""Spark-native analytics over sequence models, vectors and training corpora."""
