"""PySpark-native mail triage: features, labels, sampling, models, corrections and streams."""
