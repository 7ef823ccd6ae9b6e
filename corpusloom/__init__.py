"""A Spark-native engine that prepares, mixes, encodes and evaluates language-model corpora."""
