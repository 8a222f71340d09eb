"""mnemoframe: a Spark-native engine for versioned, bitemporal memory data."""
