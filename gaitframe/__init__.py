"""A Spark-native engine for longitudinal per-subject observation data."""
