"""A Spark-native engine for factor research, retrieval and record keeping."""
