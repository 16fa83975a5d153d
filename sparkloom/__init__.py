"""A Spark-native analytics engine: composable DataFrame operators."""
