"""treelens: a PySpark-native analytics engine for source trees."""
