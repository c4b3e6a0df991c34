"""Spark-native analytics for paired-text and code-fidelity studies."""
