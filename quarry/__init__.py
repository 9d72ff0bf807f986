"""A Spark-native library for code-intelligence and tool-usage analytics."""
