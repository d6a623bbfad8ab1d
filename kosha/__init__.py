"""kosha: a Spark-native engine that turns document collections into queryable knowledge."""
