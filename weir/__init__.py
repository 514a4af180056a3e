"""weir: a Spark-native log normalisation and shipping engine."""
