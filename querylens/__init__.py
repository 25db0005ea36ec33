"""A Spark-native analytics engine for MySQL slow-query logs."""
