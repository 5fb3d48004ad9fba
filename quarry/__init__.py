"""quarry: a Spark-native engine for code-intelligence analytics."""
