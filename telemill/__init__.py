"""telemill: a Spark-native engine for behavioural telemetry."""
