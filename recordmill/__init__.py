"""recordmill: a Spark-native engine for stores of cross-linked metadata records."""
