"""A PySpark-native analytics engine for a dynamically typed, embedded-style SQL dialect."""
