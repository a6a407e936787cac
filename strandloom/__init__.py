"""strandloom: a PySpark-native sequence-analytics engine."""
