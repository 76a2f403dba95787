"""siftwell: Spark-native retrieval, ranking analytics and corpus preparation."""
