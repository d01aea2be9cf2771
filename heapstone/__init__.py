"""heapstone: Spark-native analytics for JVM and container diagnostics, and for text corpora."""
